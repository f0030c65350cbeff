"""Restoring tokens that are cut across the chunks of a stream.

Restorer holds back the end of a text that may be the beginning of a token; events() holds whole
server-sent events. The same code runs over finished streams, sorted, and in
Structured Streaming with the held text as state.
"""

from __future__ import annotations

import codecs
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskloom.functions.text import TOKEN

# The beginning of a token at the end of a text, longest token without a mapping, held characters, waiting events, buffered characters.
CUT = re.compile(r"<{1,2}(?:[A-Z][A-Z0-9_]*)?(?:_[0-9]+[A-Z]*>?)?\Z")
NO_MAPPING_CHARS, MAX_HELD, MAX_EVENTS, BUFFER = 20, 65_536, 1024, 8_388_608
_KNOWN = re.compile(TOKEN)
_DOUBLE = re.compile(rf"<({TOKEN})>")


def restored(text: str, mapping: dict[str, str]) -> str:
    if ">" not in text:  # ends no token
        return text
    return _DOUBLE.sub(r"\1", _KNOWN.sub(lambda m: mapping.get(m[0], m[0]), text))


def longest_token(mapping: dict[str, str]) -> int:
    return max(map(len, mapping), default=NO_MAPPING_CHARS)


def split_at_cut(text: str, mapping: dict[str, str], longest: int | None = None) -> tuple[str, str]:
    """(what can go out, what may be the beginning of a token). longest: longest_token(mapping), for many calls."""
    if "<" not in text:
        return text, ""
    tail = text[-(longest_token(mapping) if longest is None else longest) - 2 :]
    m = CUT.search(tail)
    if not m or (m[0].endswith(">") and not m[0].startswith("<<")):
        return text, ""
    return text[: len(text) - len(m[0])], m[0]


class Restorer:
    """One stream of text."""

    def __init__(self, mapping: dict[str, str], state: dict | None = None):
        self.mapping, self.longest, self.held = mapping, longest_token(mapping), (state or {}).get("held", "")

    def state(self) -> dict:
        return {"held": self.held}

    def feed(self, chunk: str, last: bool = False) -> str:
        return self._feed(chunk) + (self.end() if last else "")

    def _feed(self, chunk: str) -> str:
        out, self.held = split_at_cut(self.held + chunk, self.mapping, self.longest) if self.mapping else (chunk, "")
        if len(self.held) > MAX_HELD:
            out, self.held = out + self.held, ""
        return restored(out, self.mapping) if self.mapping else out

    def end(self) -> str:
        out, self.held = self.held, ""
        return restored(out, self.mapping)


def events(buffer: str) -> tuple[list[str], str]:
    """(whole events, the rest) of a stream's text; an event ends with an empty line."""
    parts = re.split(r"\r?\n\r?\n", buffer)
    return parts[:-1], parts[-1]


class EventRestorer:
    """One stream of server-sent events with JSON data. Each string of the data is a text of its own, by its
    path; an event waits while a text before it or in it has a held end."""

    def __init__(self, mapping: dict[str, str], state: dict | None = None):
        state = state or {}
        self.mapping = mapping
        self.rest: str = state.get("rest", "")
        self.holds: dict[str, str] = state.get("holds", {})
        self.queue: list[dict] = state.get("queue", [])

    def state(self) -> dict:
        return {"rest": self.rest, "holds": self.holds, "queue": self.queue}

    def feed(self, chunk: str, last: bool = False) -> str:
        whole, self.rest = events(self.rest + chunk)
        if last and self.rest.strip():
            whole, self.rest = [*whole, self.rest], ""
        out = [self._event(e) for e in whole]
        return "".join(out) + (self._drain() if last else "")

    def _event(self, raw: str) -> str:
        data = "\n".join(line[5:].removeprefix(" ") for line in raw.splitlines() if line.startswith("data:"))
        if data.strip() == "[DONE]":
            return self._drain() + raw + "\n\n"
        try:
            node = json.loads(data)
        except ValueError:
            node = None
        if not isinstance(node, dict | list):
            self.queue.append({"raw": raw})
            return self._flush()
        held: dict[str, str] = {}
        self.queue.append({"raw": raw, "node": self._walk(node, "$", held), "held": held, "was": node})
        return self._flush()

    def _walk(self, node, path: str, held: dict[str, str]):
        if isinstance(node, str):
            out, hold = split_at_cut(self.holds.pop(path, "") + node, self.mapping)
            if len(hold) <= len(node):  # what earlier events brought is out
                for e in self.queue:
                    e.get("held", {}).pop(path, None)
            if hold:
                self.holds[path] = hold
                held[path] = hold[-len(node) :] if len(hold) > len(node) else hold
            return restored(out, self.mapping)
        if isinstance(node, list):
            return [self._walk(x, f"{path}[{k}]", held) for k, x in enumerate(node)]
        if isinstance(node, dict):
            return {k: self._walk(x, f"{path}.{k}", held) for k, x in node.items()}
        return node

    def _flush(self, whole: bool = False) -> str:
        if self.holds and not whole:
            return self._drain() if len(self.queue) >= MAX_EVENTS else ""
        out = "".join(self._rendered(e) for e in self.queue)
        self.queue = []
        return out

    def _drain(self) -> str:
        """Everything, with the held ends given back to the events that brought them."""
        for path in self.holds:
            for e in self.queue:
                if path in e.get("held", {}):
                    e["node"] = _appended(e["node"], path, "$", e["held"][path])
        self.holds = {}
        return self._flush(whole=True)

    @staticmethod
    def _rendered(e: dict) -> str:
        if "node" not in e or e["node"] == e["was"]:
            return e["raw"] + "\n\n"
        lines, done = [], False
        for line in e["raw"].splitlines():
            if not line.startswith("data:"):
                lines.append(line)
            elif not done:
                lines.append("data: " + json.dumps(e["node"], ensure_ascii=False, separators=(",", ":")))
                done = True
        return "\n".join(lines) + "\n\n"


def _appended(node, path: str, at: str, more: str):
    if isinstance(node, str):
        return node + more if at == path else node
    if isinstance(node, list):
        return [_appended(x, path, f"{at}[{k}]", more) for k, x in enumerate(node)]
    if isinstance(node, dict):
        return {k: _appended(x, path, f"{at}.{k}", more) for k, x in node.items()}
    return node


_OUT = "stream_id string, seq long, text string"


def _run(one, rows: pd.DataFrame, key) -> tuple[list, bool]:
    out, over = [], False
    for r in rows.sort_values("seq").itertuples():
        over = over or bool(r.is_last)
        out.append((key, r.seq, one.feed(r.chunk, bool(r.is_last))))
    return out, over


def _values(column: pa.Array) -> list:
    """to_pylist(), several times faster for plain values."""
    plain = not column.null_count and not pa.types.is_nested(column.type)
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


def finished(chunks: DataFrame, make) -> DataFrame:
    """(stream_id, seq, text) of whole streams chunks(stream_id, seq, chunk, is_last). A stream is handled by one task, chunk
    by chunk, by what make() gives: its chunks come sorted and in batches, so memory holds a batch and what is held back,
    however long the stream is. The time of one stream is not split."""
    kinds = {f.name: f.dataType for f in chunks.schema.fields}
    schema = T.StructType([T.StructField("stream_id", kinds["stream_id"]), T.StructField("seq", T.LongType()), T.StructField("text", T.StringType())])
    rows = chunks.select("stream_id", F.col("seq").cast("long").alias("seq"), "chunk", "is_last")

    def run(batches):
        one, now = None, None
        for b in batches:
            texts = []
            for key, chunk, last in zip(*(_values(b.column(n)) for n in ("stream_id", "chunk", "is_last")), strict=True):
                if one is None or key != now:
                    one, now = make(), key
                texts.append(one.feed(chunk, bool(last)))
            yield pa.RecordBatch.from_arrays([b.column("stream_id"), b.column("seq"), pa.array(texts, pa.string())], names=["stream_id", "seq", "text"])

    return rows.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInArrow(run, schema)


def streaming(chunks: DataFrame, make) -> DataFrame:
    """finished() over a streaming DataFrame: what make(state) gives has its state kept for each stream, until the
    stream's last chunk. Chunks of a stream arrive in order; inside of a batch they are sorted."""

    def run(key, batches, state):
        one = make(json.loads(state.get[0]) if state.exists else None)
        out, over = _run(one, pd.concat(list(batches)), key[0])
        if over:
            state.remove()
        else:
            state.update((json.dumps(one.state()),))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text"])

    return chunks.groupBy("stream_id").applyInPandasWithState(run, _OUT, "held string", "append", "NoTimeout")


class BufferedRestorer:
    """One stream of text that is restored as a whole. Beyond `most` characters the buffer is given out but for the
    longest token's length, so that what is held stays bounded."""

    def __init__(self, mapping: dict[str, str], state: dict | None = None, most: int = BUFFER):
        self.mapping, self.longest, self.most, self.held = mapping, longest_token(mapping), most, (state or {}).get("held", "")

    def state(self) -> dict:
        return {"held": self.held}

    def feed(self, chunk: str, last: bool = False) -> str:
        self.held += chunk
        if last or not self.mapping:
            out, self.held = self.held, ""
            return restored(out, self.mapping) if self.mapping else out
        if len(self.held) <= max(self.most, 2 * self.longest):
            return ""
        at = len(self.held) - self.longest
        cut, more = split_at_cut(self.held[:at], self.mapping, self.longest)  # no token is cut in two
        out, self.held = cut, more + self.held[at:]
        return restored(out, self.mapping)


class Utf8:
    """Bytes of a stream to text: a character whose bytes come in two chunks waits for the second. Bytes that are no
    UTF-8 become U+FFFD."""

    def __init__(self, pending: bytes = b""):
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")
        self.decoder.setstate((pending, 0))

    def feed(self, chunk: bytes, last: bool = False) -> str:
        return self.decoder.decode(chunk, last)

    def pending(self) -> bytes:
        return self.decoder.getstate()[0]


class BytesOf:
    """What feed() of another one makes of chunks of bytes."""

    def __init__(self, one, state: dict | None = None):
        self.one, self.utf8 = one, Utf8(bytes.fromhex((state or {}).get("pending", "")))

    def state(self) -> dict:
        return {"pending": self.utf8.pending().hex(), "one": self.one.state()}

    def feed(self, chunk: bytes, last: bool = False) -> str:
        return self.one.feed(self.utf8.feed(bytes(chunk), last), last)


def restore_buffered(chunks: DataFrame, mapping: dict[str, str], most: int = BUFFER) -> DataFrame:
    """restore_streams() with each stream held back to its end, or to `most` characters."""
    return finished(chunks, lambda state=None: BufferedRestorer(mapping, state, most))


def restore_byte_streams(chunks: DataFrame, mapping: dict[str, str], sse: bool = False) -> DataFrame:
    """restore_streams() of chunks of bytes, which may be cut inside of a character."""
    make = _maker(mapping, sse)
    return finished(chunks, lambda state=None: BytesOf(make((state or {}).get("one")), state))


def _maker(mapping: dict[str, str], sse: bool):
    kind = EventRestorer if sse else Restorer
    return lambda state=None: kind(mapping, state)


def restore_streams(chunks: DataFrame, mapping: dict[str, str], sse: bool = False) -> DataFrame:
    """(stream_id, seq, text) of finished streams chunks(stream_id, seq, chunk, is_last), restored."""
    return finished(chunks, _maker(mapping, sse))


def restore_stream(chunks: DataFrame, mapping: dict[str, str], sse: bool = False) -> DataFrame:
    """restore_streams() over a streaming DataFrame: what is held is the state of a stream, and goes with its last
    chunk."""
    return streaming(chunks, _maker(mapping, sse))
