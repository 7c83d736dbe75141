"""The prefix trie against one built of nested loops."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from contentlens.llm import prefixes, registry
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in conv.items()}


def rebuilt(conv):
    out = {}
    for c, turns in conv.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = conv.get(base, [])[:h] + turns[h:]
    return out


def nodes(conv):
    members, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c in sorted(conv):
        for d in range(len(conv[c]) + 1):
            members[tuple(conv[c][:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        value = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += value
            leaves[k[:d]] += not kids[k]
    return sorted(
        (m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(str(c) for c in m if len(conv[c]) == len(k)).encode()).hexdigest())
        for k, m in members.items()
    )


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[:2])


def chatter(seed, convs=60, most=7, say="ab"):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "user", None]), rng.choice(say) + " x" * rng.randrange(2)) for c in range(convs) for t in range(rng.randrange(1, most))]


def test_whole_query(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert rows_of(registry.op13_prefix_trie(spark, SF)) == nodes(rebuilt(ordered(map(tuple, turns.collect()))))


@pytest.mark.parametrize("seed", [0, 1])
def test_random_conversations(spark, seed):
    rows = chatter(seed)
    assert rows_of(prefixes.trie(spark.createDataFrame(rows, SCHEMA))) == nodes(ordered(rows))


def test_collisions_are_split(spark, monkeypatch):
    """Tiny primes: most groups mix prefixes, some only by what came before."""
    monkeypatch.setattr(prefixes, "PRIMES", (3, 2))
    monkeypatch.setattr(prefixes, "BASES", (2, 1))
    rows = chatter(5, convs=80, say="abcdef")
    assert rows_of(prefixes.trie(spark.createDataFrame(rows, SCHEMA))) == nodes(ordered(rows))


def test_long_conversation_over_partitions(spark, request):
    """One conversation holds most turns and lies in several partitions; another has it as a prefix; depths go over blocks."""
    turns = [(t, "user", f"w{t % 7} y") for t in range(2500)]
    rows = [(1, *t) for t in turns] + [(2, *t) for t in turns] + [(2, 9999, "user", "end")] + [(3, 0, "user", "w0 y")]
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # this table is small: it would become one partition
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    scanned = spark.read.parquet(str(prefixes.fingerprinted(df).inputFiles()[0].rsplit("/", 1)[0]))
    assert scanned.where("conv_id = 1").select("part").distinct().count() > 1
    got = {(r.conv_id, r.depth): r for r in prefixes.trie(df).collect()}
    assert len(got) == 2502 and got[1, 2500].n_convs == 2 and got[2, 2501].parent_conv_id == 1
    assert got[1, 0].saved_tokens == 2 * 2500 + 2 and got[1, 1].n_convs == 3 and got[1, 0].n_leaves == 1
    assert got[1, 2000].saved_tokens == 2 * 501 and got[1, 1].ends_sha256 == hashlib.sha256(b"3").hexdigest()


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (5, None, "user", "first"), (5, 1, None, None), (5, 1, "", ""), (5, 1, "a", "tie"), (6, None, "user", "first"),
        (6, 1, "", ""), (7, 0, "user", "x" * 100_000), (-5, 0, "user", "first"), (-5, 0, "user", "first"), (8, 3, "us", "erx"), (9, 3, "user", "x"),
    ]
    assert rows_of(prefixes.trie(spark.createDataFrame(rows, SCHEMA))) == nodes(ordered(rows))


def test_turnless_and_absent_base(spark):
    """Rebuilt conversations may have no turn; they are members of the root."""
    conv = F.col("conv_id")
    rows = [(c, t, "user", f"{c % 3}") for c in range(21, 40) for t in range(1 + c % 3)]  # conversation 20 is absent
    df = spark.createDataFrame(rows, SCHEMA)
    given = prefixes.shared_heads(df, conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4)
    want = nodes(rebuilt(ordered(rows)))
    assert rows_of(prefixes.trie(given, df)) == want and any(not v for v in rebuilt(ordered(rows)).values())


def test_copies_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "CHUNK", 16)
    rows = [(c, t, "user", f"t{t}") for c in range(300) for t in range(3)] + [(c, 0, "user", "t0") for c in range(300, 310)]
    assert rows_of(prefixes.trie(spark.createDataFrame(rows, SCHEMA))) == nodes(ordered(rows))


def test_empty_extra_columns_and_ids(spark):
    assert prefixes.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("z") for c in ("d", "f", "g", "v", "pv", "part", "n", "words", "saved")})
    assert rows_of(prefixes.trie(df)) == nodes(ordered(rows))
    with pytest.raises(TypeError):
        prefixes.trie(df.withColumn("conv_id", F.lit("a")))
