"""Prefix tree of conversations, periodic runs and quality rules, each against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import DATA, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from densigrid.llm import queries, rules, runs, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, n long, `total` string"


def conversations(seed=1):
    """Shared beginnings, exact copies, null turns, roles and texts, ties, repeated rows, rows without a conversation, one turnless."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), 101, 102, 205]:
        n = rng.choice([0, 1, 3, 8, 12])
        for t in range(n):
            rows.append((c, t, rng.choice(["user", None, ""]), rng.choice(["a", "é", "", None, "b" * 50])))
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (8, 3, "z", "tie"), (8, 3, "y", "tie"), (None, 1, "user", "nobody")]
    rows += [(300 + c, t, "user", f"same {t}") for c in range(0, 30) for t in range(3)]
    rng.shuffle(rows)
    return [(*r, 5, 6, "x") for r in rows]


def brute_tree(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role or "", hashlib.md5((text or "").encode()).digest(), text or ""))
    turns = {c: [(r, x) for _, r, _, x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, said in built.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        kids = [k for k in members if len(k) == len(p) + 1 and k[: len(p)] == p]
        leaves = sum(out[k][5] for k in kids) or 1
        saved = sum(out[k][6] for k in kids) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p))
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("block, ids, heavy", [(1024, 1024, 20_000), (2, 2, 3)])
def test_tree(spark, monkeypatch, block, ids, heavy):
    """Also with long conversations in blocks, hashes streamed over rows, and keys that count as heavy or not."""
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "IDS", ids)
    monkeypatch.setattr(trie, "HOT_KEYS", heavy)
    rows = conversations(block)
    got = trie.tree(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == brute_tree(rows)


def test_tree_is_a_chain_of_chains(spark):
    """Each conversation leaves the one before it one turn later: the tree of chains is as high as it can be."""
    rows = [(5 * c, t, "u", f"{t}" if t <= c + 20 else f"{c}") for c in range(12) for t in range(c + 23)]
    rows = [(*r, 1, 1, "") for r in rows]
    assert sorted(map(tuple, trie.tree(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == brute_tree(rows)


def test_tree_of_nothing(spark):
    assert trie.tree(spark.createDataFrame([], SCHEMA)).collect() == []
    only = spark.createDataFrame([(None, 1, "u", "x", 1, 1, "")], SCHEMA)
    assert trie.tree(only).collect() == []


def test_tree_query(spark, oracle):
    df = queries.op11_conversation_trie(spark, DATA)
    assert (sorted(df.columns), rows_of(df.columns, df.collect())) == oracle(queries.OP11)


def brute_runs(words):
    n, out = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                out.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, l, p) for (s, l), p in out.items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=6))
def test_runs(documents):
    got = runs.found([np.array(d, np.int64) for d in documents])
    assert [sorted(map(tuple, g.tolist()), key=lambda r: (r[0], r[2])) for g in got] == [sorted(brute_runs(d), key=lambda r: (r[0], r[2])) for d in documents]


def test_runs_in_slices(monkeypatch):
    monkeypatch.setattr(runs, "SLICE", 50)
    rng = random.Random(3)
    documents = [[rng.randrange(3) for _ in range(5)] * rng.randrange(1, 30) + [rng.randrange(50) for _ in range(40)] for _ in range(8)] + [[0] * 300, []]
    got = runs.found([np.array(d, np.int64) for d in documents])
    assert [g.tolist() for g in got] == [[list(r) for r in sorted(brute_runs(d), key=lambda r: (r[0], r[2]))] for d in documents]


def brute_periodic(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, l, p in found for i in range(s + p, s + l)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    lines = "".join(f"{s},{l},{p}\n" for s, l, p in found)
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


ODD = ["", None, " \x0b\x0c ", "a a a a a a", "x " * 200, "a\x1fb c", "a\xa0b " * 9, "é ü " * 30 + "z", "one two three " * 40 + "end", "same same", "same same", "w" * 100_000, "no run here at all"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", 1.0, 1, "x") for i, t in enumerate(ODD)] + [(None, "v " * 20, None, 0.0, 0, "")]
    rows += [(i, " ".join(random.Random(i).choices("abcdefg", k=60)), "en", 0.0, 2, "") for i in range(100, 160)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, n_runs int, start string")


def test_periodic(odd):
    got = runs.periodic(odd.select("doc_id", "text", "start"), ["doc_id"], runs.planted(odd)).collect()
    want = {r.doc_id: brute_periodic(r.doc_id, r.text) for r in odd.collect()}
    assert len(got) == odd.count() and {r.doc_id: tuple(r)[1:] for r in got} == want
    assert sum(1 for v in want.values() if v[0]) > 5
    plain = runs.periodic(odd, ["doc_id", "n_runs"])
    assert plain.count() == odd.count()
    assert runs.periodic(odd.limit(0), ["doc_id"], runs.planted(odd)).collect() == []


def test_periodic_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in queries.op12_periodic_runs(spark, DATA).collect()}
    some = {d for i, d in enumerate(sorted(docs)) if len(docs[d] or "") < 4000}
    assert set(got) == set(docs) and {d: got[d] for d in some} == {d: brute_periodic(d, docs[d]) for d in some}


RULED = ["", None, "word " * 49, "word " * 50, " ".join(f"w{i}x" for i in range(60)), "a b c d a b c", "a b c a b c a b", "x\ny\nx\n\n  \nx", "# $ a|b <c> **", "THE \x0b the, «la» lax 12 É É.É", "- one\n• two\n* three…\n...", "a" * 50_000, ("the cat of " + "z" * 9 + " ") * 3000, "\x1f a\xa0b c"]


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_lines": len(lines), "n_lettered_words": sum(any(c.isalpha() for c in w) for w in words),
        "base_failed": len(words) < 50 or 100 * len(covered) > 50 * len(words),
    }


def test_rules(spark, oracle):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(RULED)], "doc_id long, text string, n_words int, failed string")
    got = {r.doc_id: r.asDict() for r in rules.judged(df, ["doc_id"]).collect()}
    for i, t in enumerate(RULED):
        assert {k: got[i][k] for k in brute_rules(t)} == brute_rules(t), t
    assert rules.judged(df.limit(0), ["doc_id", "n_words"]).columns.count("n_words") == 2
    assert rules.judged(df.limit(0), ["doc_id"]).collect() == []
    assert got[9]["n_stop_words"] == 3 and got[9]["n_shouted_words"] == 2
    out = rules.judged(df, ["doc_id"])
    assert (sorted(out.columns), rows_of(out.columns, out.collect())) == oracle(queries.OP13, {"documents": df.select("doc_id", "text").toPandas()})


def test_rules_stay_one_projection(spark):
    plan = queries.op13_quality_rules(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|Arrow|Pandas|Exchange", plan)


def test_rules_against_labels(spark, oracle):
    """All that is labelled as junk goes, and of the good all stays that the base rules leave."""
    df = queries.op13_quality_rules(spark, DATA)
    assert (sorted(df.columns), rows_of(df.columns, df.collect())) == oracle(queries.OP13)
    rows = df.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    assert all(not r.kept for r in rows if r.quality == 0)
    assert all(r.kept or r.base_failed for r in rows if r.quality == 1)


def test_clean_keeps_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = rules.clean(docs)
    kept = {r.doc_id for r in queries.op13_quality_rules(spark, DATA).where("kept").collect()}
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == kept
