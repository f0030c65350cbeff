"""Operator 2: the n-gram Jaccard join by PartEnum signatures.

A document's set are its distinct word shingles, as 64-bit hashes. Two sets of a and b shingles with
Jaccard similarity of at least 3/4 differ in at most (a + b) / 7 shingles. Sets are put into bands of
nearly equal size; in a band's instance the shingle domain is cut into parts, and of k + 1 parts that
differ in k shingles at most one at least is equal. So a set signs its first k + 1 parts that are not
empty (the enumeration of subsets with one part each); a set that has too few such parts signs all
parts. Sufficiently similar sets thus share a signature, without exception.

Documents are first told by the class of their set. Of the copies in one block of documents only one
is signed; all are joined to their component by the class. Signatures are dealt by their
hash in packed blocks. A group of sets with one signature is told as a
star: its smallest set, the leader, with each other one. Links of the stars are verified and joined to
components. Where a leader's groups still lie in several components, each member meets some of them, the
pivots, and is verified with its nearest one; the members that are still apart are then compared in tiles, only across components, and once for each leader rather than once for each signature that
they share. Two filters without error come before a pair's sets are fetched: the sizes, and the
distance of small count sketches, which is never larger than the sets' difference.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.components import components, extended
from maskloom.llm.shared import broadcast_if_few, release_memory, saved

#: Words of a shingle.
WORDS = 5
#: Least and most counters of a sketch, members of a tile of a leader's open groups, rows of a tile that are compared at a time.
SKETCH, MOST_SKETCH, TILE, STRIPE = 128, 8192, 1024, 32
#: Pivots of a leader, and rounds in which each set is verified with its nearest candidate before all others.
PIVOTS, NEAREST_ROUNDS = 2, 1
#: Partners that one task verifies, signatures of a bucket of the shuffle.
PARTNERS, BUCKET_SIGNATURES = 256, 250_000
#: Characters and documents of a packed block.
BLOCK_CHARS, BLOCK_DOCUMENTS = 3_000_000, 2500
#: Bytes of text that are hashed at a time.
SLICE = 1 << 20

_U = np.uint64
_rng = np.random.default_rng(11)
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE = [_U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(30)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> _U(27)) * _U(0x94D049BB133111EB)
    return x ^ x >> _U(31)


@lru_cache(4)
def _power_table(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64."""
    return _power_table(base, max(2 * SLICE, 1 << n.bit_length()))[:n]


def _release() -> None:
    """At the end of a task's work: a worker keeps neither the tables of powers nor what it has freed."""
    _power_table.cache_clear()
    release_memory()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of data, which is in lower case."""
    b = np.frombuffer(data, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    start, end = edge[::2], edge[1::2]
    n = len(b)
    value = np.concatenate([[_U(0)], np.cumsum(_LETTER[b] * _powers(_BASE, n))])
    inverse = pow(_BASE, -1, 1 << 64)
    return start, _mix((value[end] - value[start]) * _powers(inverse, n)[start] + (end - start).astype(_U))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; null and texts without words give an empty set."""
    out: list[np.ndarray] = []
    raw = [(t or "").encode().lower() for t in texts]
    k = 0
    while k < len(raw):
        stop, size = k + 1, len(raw[k])
        while stop < len(raw) and size + len(raw[stop]) <= SLICE:
            size += len(raw[stop])
            stop += 1
        at, w = word_hashes(b"\n".join(raw[k:stop]))
        ends = np.cumsum([len(r) + 1 for r in raw[k:stop]])
        last = np.searchsorted(at, ends)
        whole = np.zeros(max(len(w) - WORDS + 1, 0), _U)
        for j in range(WORDS):
            whole += w[j : j + len(whole)] * _PLACE[j]
        whole = _mix(whole)
        a = 0
        for e in last.tolist():
            if e - a >= WORDS:
                out.append(np.unique(whole[a : e - WORDS + 1]))
            elif e > a:
                short = (w[a:e] * np.array(_PLACE[: e - a])).sum(keepdims=True) + _U(e - a)
                out.append(_mix(short))
            else:
                out.append(np.zeros(0, _U))
            a = e
        k = stop
    return out


def _bands(most: int = 1 << 40) -> np.ndarray:
    top = [1]
    while top[-1] < most:
        top.append(max(top[-1] + 1, top[-1] * 4 // 3))
    return np.array(top)


_TOP = _bands()


def instances(n: int) -> list[tuple[int, int, int]]:
    """(band, parts, signed parts) of the instances that a set of n shingles takes part in: for partners that
    are not smaller, up to 4/3 n, in each band that holds such sizes."""
    out = []
    band = int(np.searchsorted(_TOP, n))
    most = n * 4 // 3
    while True:
        top = int(_TOP[band])
        out.append((band, top * 2 * 106 // 700 + 2, (n + min(top, most)) // 7 + 1))
        if top >= most:
            return out
        band += 1


def signatures(shingles: np.ndarray, salt: int = 0) -> np.ndarray:
    """The signatures of one set, none for the empty set."""
    n = len(shingles)
    if not n:
        return np.zeros(0, _U)
    place, weight = _mix(shingles + _U(0x5851F42D4C957F2D + salt)) >> _U(32), _mix(shingles ^ _U(0x14057B7EF767814F))
    out = []
    for band, parts, signed in instances(n):
        part = (place * _U(parts) >> _U(32)).astype(np.int64)
        total = np.zeros(parts, _U)
        np.add.at(total, part, weight)
        full = np.flatnonzero(np.bincount(part, minlength=parts))
        chosen = full[:signed] if len(full) >= signed else np.arange(parts)
        out.append(_mix(total[chosen] + (chosen.astype(_U) + _U(band) * _U(1 << 40)) * _PLACE[3]))
    return np.concatenate(out)


def sketch(shingles: np.ndarray) -> bytes:
    """Counts of shingles by hash, 255 at most, about one counter for three shingles. Two sketches, the longer one
    folded to the length of the other, are never further apart than their sets."""
    n = SKETCH
    while 3 * n < len(shingles) and n < MOST_SKETCH:
        n *= 2
    counts = np.bincount((_mix(shingles * _PLACE[4]) & _U(n - 1)).astype(np.int64), minlength=n)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _folded(rows: list[bytes], n: int) -> np.ndarray:
    """Sketches as rows of n counters."""
    if all(len(r) == n for r in rows):
        return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, n).astype(np.int16)
    return np.stack([np.frombuffer(r, np.uint8).reshape(-1, n).sum(axis=0, dtype=np.int16) for r in rows])


def _apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Distances of pairs of sketches."""
    sizes = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)])
    out = np.zeros(len(a), np.int64)
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        for k in range(0, len(at), 4096):
            part = at[k : k + 4096].tolist()
            out[part] = np.abs(_folded([a[i] for i in part], n) - _folded([b[i] for i in part], n)).sum(axis=1, dtype=np.int64)
    return out


def set_id(shingles: np.ndarray) -> int:
    """A number of the set as a whole: equal sets are one class."""
    both = shingles.sum(keepdims=True) * _PLACE[0] + np.bitwise_xor.reduce(_mix(shingles + _U(1)), keepdims=True) * _PLACE[1]
    return int(_mix(both + _U(len(shingles))).view(np.int64)[0])


def similar(a: int, b: int, shared: int) -> bool:
    return 100 * shared >= 75 * (a + b - shared)


_PACKED = "bucket int, signatures binary, signer binary"
_STARS = "leader long, member long"
_PAIRS = "a long, b long, apart long"
_CLASSES = "doc_id long, cls long, size long, sketch binary"


def _classes(batches):
    """Documents to their classes. Of the copies in a batch the first has the sketch."""
    for t in batches:
        sets = shingle_sets(t.column(1).to_pylist())
        cls = [set_id(s) if len(s) else 0 for s in sets]
        seen: set[int] = {0}
        sketches = [None if c in seen or seen.add(c) else sketch(s) for c, s in zip(cls, sets, strict=True)]
        yield pa.RecordBatch.from_pydict({"doc_id": t.column(0), "cls": pa.array(cls, pa.int64()), "size": pa.array([len(s) for s in sets], pa.int64()), "sketch": pa.array(sketches, pa.binary())})
        del sets, sketches
        _release()


def _pack(buckets: int):
    """Texts to blocks: for each bucket the signatures that fall into it, and who signed. A block signs each of
    its sets once; empty sets are not signed."""

    def block(texts: list) -> pa.RecordBatch:
        sets = {set_id(s): s for s in shingle_sets(texts) if len(s)}
        cls = np.array(list(sets), np.int64)
        signed = [signatures(s) for s in sets.values()]
        flat = np.concatenate([*signed, np.zeros(0, _U)])
        signer = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in signed])
        home = (flat >> _U(32)) % _U(buckets)
        order = np.argsort(home.astype(np.uint16) if buckets < 65536 else home, kind="stable")
        home, low, signer = home[order], (flat & _U(0xFFFFFFFF)).astype(np.uint32)[order], signer[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(home)) + 1, [len(home)]]).tolist()
        rows: dict[str, list] = {"bucket": [], "signatures": [], "signer": []}
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            signers, index = np.unique(signer[a:b], return_inverse=True)
            rows["bucket"].append(int(home[a]))
            rows["signatures"].append(low[a:b].tobytes())
            rows["signer"].append(index.astype(np.uint16).tobytes() + cls[signers].tobytes())
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "bucket" else pa.binary()) for k, v in rows.items()})

    def pack(batches):
        texts: list = []
        size = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                texts.append(t)
                size += len(t or "")
                if size > BLOCK_CHARS or len(texts) >= BLOCK_DOCUMENTS:
                    yield block(texts)
                    texts, size = [], 0
        if texts:
            yield block(texts)
            texts = []
        _release()

    return pack


def _meet(table: pa.Table) -> pa.Table:
    """(leader, member) of the stars of a bucket's groups, each pair once."""
    table = table.combine_chunks()
    low, cls = [], []
    for s, w in zip(table["signatures"].to_pylist(), table["signer"].to_pylist(), strict=True):
        values = np.frombuffer(s, np.uint32)
        low.append(values)
        cls.append(np.frombuffer(w[2 * len(values) :], np.int64)[np.frombuffer(w[: 2 * len(values)], np.uint16)])
    value, member = np.concatenate(low), np.concatenate(cls)
    order = np.lexsort((member, value))
    value, member = value[order], member[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (member[1:] != member[:-1])  # copies are one class
    value, member = value[fresh], member[fresh]
    first = np.ones(len(value), bool)
    first[1:] = value[1:] != value[:-1]
    leader = member[np.maximum.accumulate(np.where(first, np.arange(len(value)), 0))]
    pairs = np.unique(np.stack([leader[~first], member[~first]], axis=1), axis=0)
    del low, cls, value, member, order, fresh, leader, first
    release_memory()
    return pa.table({"leader": pa.array(pairs[:, 0]), "member": pa.array(pairs[:, 1])})


def _fits_of(size_a: np.ndarray, sketch_a: list[bytes], size_b: np.ndarray, sketch_b: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs: whether sizes and sketches allow a link, and how far the sketches are apart."""
    apart = _apart(sketch_a, sketch_b)
    return (100 * np.minimum(size_a, size_b) >= 75 * np.maximum(size_a, size_b)) & (7 * apart <= size_a + size_b), apart


def _fits(batches):
    """Pairs with sizes and sketches to the pairs that can be links, and how far their sketches are apart."""
    for t in batches:
        if t.num_rows:
            good, apart = _fits_of(t.column("size_a").to_numpy(), t.column("sketch_a").to_pylist(), t.column("size_b").to_numpy(), t.column("sketch_b").to_pylist())
            yield pa.RecordBatch.from_pydict({"a": t.column("a"), "b": t.column("b"), "apart": pa.array(apart, pa.int64())}).filter(pa.array(good))


def _near(size: np.ndarray, comp: np.ndarray, sketches: list[bytes], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of left by right (the same array: each pair once) the pairs of different components that sizes and sketches
    allow, and how far their sketches are apart."""
    same = left is right
    left, right = left[np.argsort(size[left], kind="stable")], right[np.argsort(size[right], kind="stable")]
    small = _folded([sketches[k] for k in right.tolist()], SKETCH)
    mine = small if same else _folded([sketches[k] for k in left.tolist()], SKETCH)
    sizes, found = size[right], [(np.zeros(0, np.int64),) * 2]
    for k in range(0, len(left), STRIPE):
        part = left[k : k + STRIPE]
        a = np.searchsorted(100 * sizes, 75 * size[part[0]])
        b = np.searchsorted(75 * sizes, 100 * size[part[-1]], side="right")
        for c in range(k if same else a, b, 1024):
            other = right[c : min(c + 1024, b)]
            apart = np.abs(mine[k : k + STRIPE, None] - small[None, c : c + len(other)]).sum(axis=2, dtype=np.int32)
            good = (comp[part][:, None] != comp[other]) & (7 * apart <= size[part][:, None] + size[other])
            if same:
                good &= np.arange(k, k + len(part))[:, None] < np.arange(c, c + len(other))
            i, j = np.nonzero(good)
            found.append((part[i], other[j]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    good, apart = np.zeros(len(i), bool), np.zeros(len(i), np.int64)
    for k in range(0, len(i), 20_000):
        p, q = i[k : k + 20_000], j[k : k + 20_000]
        good[k : k + 20_000], apart[k : k + 20_000] = _fits_of(size[p], [sketches[x] for x in p.tolist()], size[q], [sketches[x] for x in q.tolist()])
    return i[good], j[good], apart[good]


def _across(batches):
    """Sorted tiles of leaders, a pair of tiles after the other: pairs of different components that sizes and
    sketches allow and that have no smaller leader in common."""
    carried: list[pa.RecordBatch] = []

    def pairs(t: pa.Table) -> pa.RecordBatch:
        leader, low, high, tile, cls, comp, size = (t[c].to_numpy() for c in ("leader", "low", "high", "tile", "cls", "component", "size"))
        sketches = t["sketch"].to_pylist()
        edge = np.flatnonzero((np.diff(leader) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) + 1
        found = [(np.zeros(0, np.int64),) * 3]
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(cls)], strict=True):
            left = np.flatnonzero(tile[a:b] == low[a]) + a
            right = left if low[a] == high[a] else np.flatnonzero(tile[a:b] == high[a]) + a
            if len(left) and len(right):
                found.append(_near(size, comp, sketches, left, right))
        i, j, apart = (np.concatenate(x) for x in zip(*found, strict=True))
        own = {k: set(t["leaders"][k].as_py()) for k in np.unique(np.concatenate([i, j])).tolist()}
        once = np.array([min(own[x] & own[y]) == of for x, y, of in zip(i.tolist(), j.tolist(), leader[i].tolist(), strict=True)], bool)
        one, other = np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])
        return pa.RecordBatch.from_pydict({"a": pa.array(one[once]), "b": pa.array(other[once]), "apart": pa.array(apart[once])})

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*carried, batch])
        key = [table[c].to_numpy() for c in ("leader", "low", "high")]
        last = np.flatnonzero(np.any([k != k[-1] for k in key], axis=0))
        cut = int(last[-1]) + 1 if len(last) else 0  # the last pair of tiles may go on
        carried = table.slice(cut).to_batches()
        if cut:
            yield pairs(table.slice(0, cut))
    if carried:
        yield pairs(pa.Table.from_batches(carried))
        carried = []
    _release()


def _sets(batches):
    for t in batches:
        sets = shingle_sets(t.column(0).to_pylist())
        yield pa.RecordBatch.from_pydict({"cls": pa.array([set_id(s) if len(s) else 0 for s in sets], pa.int64()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})
    _release()


def _verify(left: pa.Table, right: pa.Table) -> pa.Table:
    """A set and its partners: the links."""
    out = []
    if left.num_rows and right.num_rows:
        mine = np.frombuffer(left["mine"][0].as_py(), _U)
        for b, other in zip(right["b"].to_pylist(), right["theirs"], strict=True):
            theirs = np.frombuffer(other.as_py(), _U)
            small, large = (mine, theirs) if len(mine) <= len(theirs) else (theirs, mine)
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            if similar(len(mine), len(theirs), int((large[at] == small).sum())):
                out.append(b)
    a = left["a"][0].as_py() if out else 0
    return pa.table({"a": pa.array([a] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})


def _sets_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """cls, shingles of the classes in pairs(a, b): sets are made again, from the texts of one document of each."""
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted = broadcast_if_few(saved(ends.join(classes, "cls").select(F.col("doc_id").alias("wanted")).distinct(), "wanted"))
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["wanted"]), "left_semi").select("text")
    return saved(texts.mapInArrow(_sets, "cls long, shingles binary"), "sets")


def _links(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are links; a class with many partners is dealt to several tasks."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts"))
    dealt = saved(pairs.join(salts, "a").select("a", "b", "salts", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt")), "pairs")
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("theirs")).join(broadcast_if_few(dealt.select("a", "b", "salt")), "b").select(F.col("a").alias("of"), F.col("salt").alias("part"), "b", "theirs")
    heads = broadcast_if_few(dealt.select("a", "salts").distinct(), dealt)
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("mine")).join(heads, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "mine")
    return left.groupBy("a", "salt").cogroup(right.groupBy("of", "part")).applyInArrow(_verify, "a long, b long")


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, apart) the nearest partner of each class, as (a, b)."""
    ends = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))
    nearest = ends.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("to"))
    return nearest.select(F.least("a", "to.b").alias("a"), F.greatest("a", "to.b").alias("b")).distinct()


def _labels(classes: DataFrame, links: DataFrame) -> DataFrame:
    joined = components(links).withColumnRenamed("node", "cls")
    return saved(classes.join(joined, "cls", "left").select("cls", F.coalesce("component", "cls").alias("component")), "classes")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(cls, component) with the links (a, b) of two of these classes."""
    return extended(labels.withColumnRenamed("cls", "node"), saved(links, "links")).withColumnRenamed("node", "cls")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of docs(doc_id, text).

    Null and empty texts and texts without words have an empty set and link with nothing; component_id is
    then doc_id. Repeated rows are equal sets. A row without doc_id takes part in links, but the smallest id
    is taken over the others (null if there is none). An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(12, volume // 10 // BUCKET_SIGNATURES))
    info = saved(docs.mapInArrow(_classes, _CLASSES), "documents")
    classes = info.filter("size > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size"), F.first("sketch", ignorenulls=True).alias("sketch"))
    classes = saved(classes, "classes")
    stars = saved(docs.select("text").mapInArrow(_pack(buckets), _PACKED).groupBy("bucket").applyInArrow(_meet, _STARS).distinct(), "stars")
    one = lambda side: classes.select(F.col("cls").alias(side), F.col("size").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}"))
    pairs = stars.select(F.col("leader").alias("a"), F.col("member").alias("b")).join(one("a"), "a").join(one("b"), "b")
    pairs = saved(pairs.mapInArrow(_fits, _PAIRS).select("a", "b"), "pairs")
    links = saved(_links(_sets_of(docs, classes, pairs), pairs), "links")
    labels = _labels(classes, links)
    near = saved(_nearest(_to_pivots(_crowds(stars, classes, labels))), "pairs")
    if not near.isEmpty():
        labels = _joined(labels, _links(_sets_of(docs, classes, near), near))
    left = saved(_open_pairs(_crowds(stars, classes, labels)).join(near, ["a", "b"], "left_anti"), "pairs")
    sets = None
    for k in range(NEAREST_ROUNDS + 1):
        if left.isEmpty():
            break
        # the nearest partner of each first: most of the others are then in one component
        sets = sets or _sets_of(docs, classes, left)
        tried = saved(_nearest(left) if k < NEAREST_ROUNDS else left.select("a", "b"), "pairs")
        labels = _joined(labels, _links(sets, tried))
        end = lambda side: labels.select(F.col("cls").alias(side), F.col("component").alias(f"component_{side}"))  # noqa: B023, E731
        open_ = left.join(end("a"), "a").join(end("b"), "b").filter("component_a <> component_b")
        left = saved(open_.select("a", "b", "apart").join(tried, ["a", "b"], "left_anti"), "pairs")
    smallest = labels.join(classes.select("cls", "doc_id"), "cls").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = labels.join(smallest, "component").select("cls", "component_id")
    linked = info.filter("size > 0").join(by_class, "cls").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    empty = info.filter("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(empty)


def _crowds(stars: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """leader, tiles, cls, leaders, component, size, sketch of the sets, the leader among them, of each leader whose groups
    lie in several components; tiles: in how many parts they are compared, of about TILE sets each; leaders: all these
    leaders of a set, one for each of its signatures and itself at most."""
    near = stars.join(labels.withColumnRenamed("cls", "member"), "member").select("leader", "component")
    spans = near.groupBy("leader").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most"))
    home = labels.select(F.col("cls").alias("leader"), F.col("component").alias("home"))
    leaders = spans.join(home, "leader").filter("n > 1 AND (least <> home OR most <> home)")
    leaders = saved(leaders.select("leader", F.ceil((F.col("n") + 1) / TILE).cast("int").alias("tiles")), "leaders")
    members = stars.join(leaders, "leader").select("leader", "tiles", F.col("member").alias("cls"))
    members = members.union(leaders.select("leader", "tiles", F.col("leader").alias("cls")))
    members = members.withColumn("leaders", F.collect_list("leader").over(Window.partitionBy("cls")))
    described = saved(labels.join(classes.select("cls", "size", "sketch"), "cls"), "described")
    return saved(members.join(described, "cls"), "crowds")


def _to_pivots(crowds: DataFrame) -> DataFrame:
    """Pairs (a, b, apart) of different components that the filters allow, a being one of some members of its leader: the
    smallest of each of so many parts. The pairs grow with the number of members."""
    chosen = crowds.filter("cls <> leader").groupBy("leader", F.pmod(F.xxhash64("cls"), F.lit(PIVOTS)).alias("part")).agg(F.min("cls").alias("cls")).select("leader", "cls")
    side = lambda s: [F.col(c).alias(d) for c, d in (("cls", s), *((c, f"{c}_{s}") for c in ("component", "size", "sketch")))]
    ones = crowds.join(chosen, ["leader", "cls"]).select("leader", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), *side("a"))
    others = crowds.select("leader", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int").alias("tile"), *side("b"))
    met = ones.join(others, ["leader", "tile"]).filter("component_a <> component_b AND 100 * least(size_a, size_b) >= 75 * greatest(size_a, size_b)")
    return met.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(_fits, _PAIRS)


def _open_pairs(crowds: DataFrame) -> DataFrame:
    """All pairs of the members of a leader across components that the filters allow, compared in tiles, never as a whole.
    A pair of several leaders is told once, by the smallest of them."""
    members = crowds.withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    met = members.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "leader", F.least("tile", "partner").alias("low"), F.greatest("tile", "partner").alias("high"), "tile", "cls", "leaders", "component", "size", "sketch"
    )
    keys = ["leader", "low", "high"]
    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_across, _PAIRS)


def kept_documents(docs: DataFrame) -> DataFrame:
    """Of each component the document with the smallest doc_id, with the columns of docs; what links with nothing
    stays. Rows that share a doc_id stay or go together; rows without one stay."""
    rows = near_duplicates(docs).filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("gone")).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept"))
    gone = saved(rows.filter("NOT kept").select("gone"), "gone")
    return docs.join(broadcast_if_few(gone), docs["doc_id"] == gone["gone"], "left_anti")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ways AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 75 * (na.n + nb.n - p.c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""
