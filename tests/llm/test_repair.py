"""The repair against a search of all edits, its SQL, and its edges."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from maskloom.llm import queries, repair

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def hurt(rows):
    """Rows (conv_id, turn, role, text) after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def faults(rows):
    seen = set()
    for _, _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        yield "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
        seen.add((role, text))


def cheapest(rows, most_inserts=4):
    """(cost, audit, lines) by trying all edits of all rows, with turns put in anywhere."""
    flags, best = list(faults(rows)), None

    def tried(k, inserts, cost, audit, turns):
        nonlocal best
        if best and cost > best[0]:
            return
        if k == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(t[0][:1] for t in turns)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, [f"{r}:{t}" for r, t in turns]
        else:
            _, _, role, text = rows[k]
            tried(k + 1, inserts, cost + 3, audit + "D", turns)
            if flags[k] not in ("blank", "duplicate"):
                late = flags[k] == "truncated"
                tried(k + 1, inserts, cost + late, audit + "K", [*turns, (role, text)])
                for new in ("user", "assistant"):
                    tried(k + 1, inserts, cost + late + 2, audit + "R", [*turns, (new, text)])
        if inserts:
            for new in ("user", "assistant"):
                tried(k, inserts - 1, cost + 2, audit + "I", [*turns, (new, "")])

    tried(0, most_inserts, 0, "", [])
    return best


def plain(rows, conv):
    mine = hurt([r for r in rows if r[0] == conv])
    flags = list(faults(mine))
    turns = [r[1] for r in mine if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, lines = cheapest(mine)
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
    return conv, gaps, *(flags.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def random_rows(n, seed):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "useful", None], ["Yes.", "no", " \n", "Why?\t ", "Yes.", "é!", None, ""]
    out = []
    for conv in range(n):
        for turn in range(rng.randint(0, 5)):
            out.append((conv if conv else None, rng.choice([turn, turn, turn, turn + 7, None]), rng.choices(roles, [8, 8, 4, 1, 1, 1])[0], rng.choice(texts)))
    return out + rng.sample(out, n // 10)


def test_against_all_edits(spark):
    rows = random_rows(150, 3)
    got = {r[0]: tuple(r) for r in repair.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    convs = {r[0] for r in rows}
    assert got.keys() == convs
    for conv in convs:
        assert got[conv] == plain(rows, conv)


def test_sql(spark, tmp_path):
    con = duckdb.connect()
    rows = random_rows(60, 8)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    for folder, files in ((SF, ""), (str(tmp_path), "/*.parquet")):
        con.sql(f"create or replace view conversations as select * from '{folder}/conversations.parquet{files}'")
        got, want = queries.op11_conversation_repair(spark, folder), con.sql(repair.ORACLE_SQL)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("n", [1, 2, 511, 512, 513, 1500])
def test_blocks_are_joined(spark, n):
    """Long conversations need several blocks: every second row is a user's, with a hole in the middle."""
    rows = [(1, k, "user" if (k + (k > n // 2)) % 2 == 0 else "assistant", f"{k}.", 0) for k in range(n)]
    row = repair.repaired(spark.createDataFrame(rows, SCHEMA + ", copy int")).first()
    letters = ["u" if r[2] == "user" else "a" for r in rows]
    holes = sum(a == b for a, b in itertools.pairwise(letters)) + (letters[0] == "a") + (letters[-1] == "u")
    assert row.cost == 2 * holes and row.illegal == sum(a == b for a, b in itertools.pairwise(letters))
    assert re.fullmatch("(ua)*", "".join(x[0] for x in row.repaired)) and len(row.turns) == n
    assert [x for x in row.repaired if x.split(":")[1]] == [f"{r[2]}:{r[3]}" for r in rows]


def test_many_turns_in_linear_time(spark):
    rows = spark.range(60_000).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 3 = 0, 'user', 'assistant') AS role", "concat(id, '.') AS text", "0 AS copy")
    row = repair.repaired(rows).select("cost", "audit", "repaired").first()
    # user, assistant, assistant: an edit of cost 2 for each three rows, or one more turn
    assert row.cost == 40_000 and re.fullmatch("(ua)*", "".join(x[0] for x in row.repaired))


def test_edges(spark):
    empty = repair.digest(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns[0] == "conv_id"
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    whole = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 > 4)
    long = "a " * 500_000 + "."
    rows = [(gone, 0, "user", "x."), (whole, 0, "user", long)]
    got = {r.conv_id: r for r in repair.digest(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS audit", "2 AS blank", "3 AS copy")).collect()}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[whole].audit == "KI" and got[whole].repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:".encode()).hexdigest()
