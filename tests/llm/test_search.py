"""Near-duplicates, contamination, personal data and quotations against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from conftest import DATA, rows_of

from densigrid.llm import bagminhash as B
from densigrid.llm import decontaminate, pii, queries, quotes


def brute_classes(ids, texts):
    shingler = B.Shingler()
    sets = [shingler.multiset(t or "") for t in texts]
    keys = [shingler.words(t or "").tobytes() for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if keys[i] == keys[j] or (len(keys[i]) and len(keys[j]) and B.similarity(sets[i], sets[j]) >= B.SIMILAR):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {ids[i]: ids[root(i)] for i in range(len(texts))}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    for n in (3, 40, 400):
        v = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        a = np.where(rng.random(2 * n) < 0.6, rng.integers(1, 12, 2 * n), 0)
        b = np.where(rng.random(2 * n) < 0.6, a, np.where(rng.random(2 * n) < 0.5, rng.integers(1, 12, 2 * n), 0))
        hits = []
        for k in range(40):
            w = B.mix(v + np.uint64(7919 * k))
            s = B.signatures(np.concatenate([w[a > 0], w[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()]), 2)
            hits.append((s[0] == s[1]).mean())
        assert abs(np.mean(hits) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.035


def test_classes_of_documents(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    got = {r.doc_id: r.class_id for r in queries.op3_near_duplicates(spark, DATA).collect()}
    assert got == brute_classes(*zip(*docs))


@pytest.mark.parametrize("block", [500, 4])
def test_chains_copies_and_odd_texts(spark, monkeypatch, block):
    """Groups whose members drift apart, so that leaders do not see all of them; nulls, repeats and short texts."""
    monkeypatch.setattr(B, "BLOCK_ROWS", block)
    monkeypatch.setattr(B, "SALTED", block)
    rng, texts = random.Random(4), []
    for g in range(2):
        words = [f"g{g}w{i}" for i in range(60)]
        for k in range(24):
            words = list(words)
            words[rng.randrange(60)] = f"x{g}_{k}"
            texts.append(" ".join(words))
    texts += ["", "  ", None, "one two", "one two", "ONE two", texts[0], texts[5] + " ", "z " * 30_000]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, text_key string, bands string")
    got = {r.doc_id: r.class_id for r in B.classes(df).collect()}
    want = brute_classes(range(len(texts)), texts)
    assert got == want
    kept = B.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_one_row_stays_of_repeated_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "other words stand here now"), (None, "no id at all"), (None, "no id at all"), (3, "a third text of that id")]
    kept = B.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "no id at all"), (1, "a b c d e f"), (3, "a third text of that id"), (3, "other words stand here now")]


def test_columns_of_any_name(spark):
    """Columns named like those that the operators make, with dots and quotes, come back as they were."""
    names = ["doc_id", "text", "h1", "H2", "a.b", "q`t", "hash", "__hash", "__doc", "__score", "__leaked", "text_hash", "email", "terms", "term", "keep"]
    rows = [(i, t, *[f"{n}{i}" for n in names[2:]]) for i, t in enumerate(["a b c d e f", "A b c d e f", "jo@x.org is not a test item", None, "one two three four five six"])]
    df = spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    for got, left in ((B.one_of_each(df), [0, 2, 3, 4]), (decontaminate.clean(df, items), [0, 1, 2, 3]), (pii.sanitise(df), [0, 1, 2, 3, 4])):
        assert got.columns == names
        assert sorted((r[0], *r[2:]) for r in got.collect()) == [(r[0], *r[2:]) for r in rows if r[0] in left]


@pytest.mark.parametrize("columns", ["doc_id long, text string", "doc_id long, text string, n_chars long"])
def test_empty_tables(spark, columns):
    none, items = spark.createDataFrame([], columns), spark.createDataFrame([], "item_id long, text string")
    for got in (B.one_of_each(none), decontaminate.clean(none, items), pii.sanitise(none)):
        assert got.columns == none.columns and got.count() == 0
    assert B.classes(none).count() == pii.find(none).count() == decontaminate.contamination(none, items).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.root for r in B.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_contamination(spark, oracle):
    df = queries.op9_decontamination(spark, DATA)
    assert (sorted(df.columns), rows_of(df.columns, df.collect())) == oracle(queries.OP9)


def test_contamination_of_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, ""), (5, item + " nu xi omicron pi rho sigma tau upsilon phi chi psi omega one two three")], "item_id long, text string")
    long = "filler word " * 20_000
    docs = [(1, long + item.upper().replace(" ", ", ") + "! " + long), (2, item[:-12]), (3, None), (4, ""), (5, "too short"), (6, "alpha beta gamma delta"), (7, item), (7, item)]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, shingle string")
    got = sorted((r.doc_id, r.contaminated, r.item_ids, round(r.containment, 3)) for r in decontaminate.contamination(df, items).collect())
    assert got == [(1, True, "1", 1.0), (2, False, "", 0.0), (3, False, "", 0.0), (4, False, "", 0.0), (5, False, "", 0.0), (6, False, "", 0.0), (7, True, "1", 1.0), (7, True, "1", 1.0)]
    assert sorted(r.doc_id for r in decontaminate.clean(df, items).collect()) == [2, 3, 4, 5, 6]
    assert decontaminate.clean(df, items).columns == df.columns
    assert not any(r.contaminated for r in decontaminate.contamination(df, items.limit(0)).collect())


def test_partitions_of_items(spark):
    """Items of many sizes, in documents that hold about 0.8 of them and less, against exact containment."""
    rng, items, docs = random.Random(6), [], []
    for i, n in enumerate([6, 9, 14, 20, 40, 90, 200, 500, 1100, 2500]):
        words = [f"i{i}w{k}" for k in range(n)]
        items.append((i, " ".join(words)))
        for share in (1.0, 0.85, 0.8, 0.75, 0.5):
            for _ in range(4):
                a = rng.randrange(n - int(share * n) + 1)
                docs.append((len(docs), " ".join([*(f"d{len(docs)}x{k}" for k in range(300)), *words[a : a + int(share * n)], "end"])))
    runs = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    item_runs = {i: runs(t) for i, t in items}
    want = {(d, str(i)) for d, t in docs for has in [runs(t)] for i, s in item_runs.items() if len(s & has) >= 0.8 * len(s)}
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).where("contaminated").collect()
    assert {(r.doc_id, r.item_ids) for r in got} == want and 60 < len(want) < 160


def test_parameters_of_partitions():
    for m in range(1, 60):
        h = decontaminate.least_hits(m)
        below = sum(decontaminate.comb(m, k) * 0.8**k * 0.2 ** (m - k) for k in range(h))
        assert h == 1 or below <= decontaminate.MISS
    assert [decontaminate.lookups(k) for k in (4, 10, 99)] == [18, 30, 50]


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute_spans(text):
    def fits(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS for m in re.finditer(p, text or "") if fits(k, m.group(0))]


def test_base_spans(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("a1@.-+%_ 0()9é😀\n25") for _ in range(rng.randrange(80))) for _ in range(400)]
    texts += ["b@c.d%x@e.f a@b.c@d.e @x.y a..b@c-.d", "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.01", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (462) 555-7216. +12 +1234567890123456", "😀 x@y.z 😀 10.0.0.1", None, "", "9" * 20_000, "a" * 50_000 + "@b", "1 " * 20_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, email string")
    for r in pii.find(docs).collect():
        spans = brute_spans(texts[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for k, *_ in spans) for n, _ in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.spans.startswith(text)


def disclosing(spark):
    rng = random.Random(3)
    filler = lambda: " ".join(rng.choice("lorem ipsum dolor amet consectetur adipiscing elit sed eiusmod tempor".split()) for _ in range(12))
    rows = [(i, f"{filler()} Zanzibarian {' '.join(filler().split()[:5])} jo@example.org {filler()} Zanzibarian", len("x")) for i in range(6)]
    rows += [(i, filler(), 1) for i in range(6, 60)] + [(60, "Zanzibarian alone", 1), (61, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long")


def test_words_that_disclose(spark):
    docs = disclosing(spark)
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert all(got[i].n_term == 2 and got[i].n_email == 1 for i in range(6))
    assert all(got[i].n_term == 0 for i in range(6, 62)), "texts without an entity are left alone"
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert all("Zanzibarian" not in clean[i].text and "jo@" not in clean[i].text and "[EMAIL]" in clean[i].text and clean[i].n_chars == len(clean[i].text) for i in range(6))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(clean[i].text == texts[i] for i in range(6, 62))


def brute_terms(texts):
    """For each text, the words that disclose one of its entities, and whether to remove them."""
    from collections import defaultdict
    from math import factorial, log2

    words = [set(re.findall(r"[^\W_]{4,}", (t or "").lower())) for t in texts]
    documents, contexts, rows, beside, having, formed = defaultdict(int), defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set), set()
    for w in words:
        for t in w:
            documents[t] += 1
    for i, text in enumerate(texts):
        for kind, a, b in brute_spans(text):
            before, after = text[max(0, a - pii.CONTEXT - 1) : a], text[b : b + pii.CONTEXT + 1]
            before = re.sub(r"^[^\W_]+", "", before) if len(before) > pii.CONTEXT else before
            after = re.sub(r"[^\W_]+$", "", after) if len(after) > pii.CONTEXT else after
            near = frozenset(re.findall(r"[^\W_]{4,}", (before + " " + after).lower()))
            e = kind, text[a:b].lower()
            having[e].add(i)
            names = set(re.findall(r"[^\W\d_]{4,}", e[1].split("@")[0])) if kind == "email" else set()
            for t in near:
                key = (*e, t)
                contexts[key].add(near)
                rows[key].add(i)
                beside[i].add(key)
                if t in names:
                    formed.add((i, key))

    def judged(key):
        """Bits that are left, or None where the word discloses nothing."""
        c, d, p = len(contexts[key]), documents[key[2]], len(having[key[:2]]) / len(texts)
        bits = -log2(len(rows[key]) / d * c / (c + pii.PRIOR))
        if c < 2 or p == 1 or bits > pii.GENERALISE or (-log2(p) - bits) / -log2(p) < pii.DISCLOSED:
            return None
        return bits if (max(1, d - 1) * p) ** (c - 1) / factorial(min(64, c - 1)) <= pii.CHANCE else None

    out = []
    for i in range(len(texts)):
        told = defaultdict(bool)
        for k in beside[i]:
            bits = judged(k)
            if bits is not None or (i, k) in formed:
                told[k[2]] |= bits is not None and bits <= pii.REMOVE
        out.append(dict(told))
    return out


def test_terms_of_the_table(spark):
    """The corpus counts, thresholds and spans of terms against plain Python; the method finds some on this table."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.collect()
    want = {r.doc_id: t for r, t in zip(rows, brute_terms([r.text for r in rows]))}
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    for r in rows:
        base = [(a, b) for _, a, b in brute_spans(r.text)]
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", r.text or "") if m[0].lower() in want[r.doc_id]]
        spans = [(a, b) for a, b in spans if not any(c < b and a < d for c, d in base)]
        got = [tuple(map(int, s.split(":")[1:])) for s in found[r.doc_id].spans.split(",") if s.startswith("term:")]
        assert got == spans


def test_an_entity_in_very_many_texts(spark):
    """A footer's address in all texts, with a word of its own beside it in each: what stands there once is no evidence."""
    rows = [(i, f"Text about nothing by unique{i:03d}x who is at desk@example.org every day") for i in range(60)]
    rows += [(i, "Text about nothing every day") for i in range(60, 300)]
    got = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id < 60").collect()
    assert {r.text for r in got} == {f"Text about nothing by unique{i:03d}x who is at [EMAIL] every day" for i in range(60)}


def planted_people(seed, people=40, texts=2000):
    """Texts of frequent and rare words.  Each person has a name, an address of no relation to it, and 2 to 5 texts that have both; some
    words that occur once, others that occur twice, stand beside addresses by chance."""
    rng = random.Random(seed)
    often = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    rare = [f"{''.join(rng.choices('klmnopqrst', k=7))}{i}" for i in range(6000)]
    names = [f"{''.join(rng.choices('uvwxyz', k=8))}{i}" for i in range(people)]
    filler = lambda n: [rng.choice(rare) if rng.random() < 0.15 else rng.choice(often) for _ in range(n)]
    rows = [" ".join(filler(60)) for _ in range(texts)]
    for i, name in enumerate(names):
        for t in rng.sample(range(texts), rng.randrange(2, 6)):
            w = rows[t].split(" ")
            at = rng.randrange(len(w))
            w[at:at] = [name, *filler(2), f"box{i}@example.org"]
            rows[t] = " ".join(w)
    for i in range(200):  # addresses of nobody
        t = rng.randrange(texts)
        rows[t] += f" mail x{i}q@example.net {rng.choice(rare)}"
    return names, rows


def test_precision_and_recall_on_planted_names(spark):
    names, rows = planted_people(6)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    told = {t["term"] for r in pii.disclosing_terms(docs).collect() for t in r.terms}
    hit = told & set(names)
    assert len(hit) >= 0.95 * len(names) and len(hit) >= 0.9 * len(told)
    want = brute_terms(rows)
    assert told == {t for w in want for t in w}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all(n not in clean[i] for i, text in enumerate(rows) for n in hit if n in text and "box" in text)


def test_names_by_form(spark):
    rows = [(1, "Write to Johann Meier at johann.meier77@example.org or to Anna there"), (2, "Johann was here"), (3, "Call meier at 10.0.0.1"), (4, "anna@example.org anna Annabel")]
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "Write to [WORD] [WORD] at [EMAIL] or to Anna there", 2: "Johann was here", 3: "Call meier at [IP]", 4: "[EMAIL] [WORD] Annabel"}


@pytest.mark.parametrize("at", ["first", "last", "left edge", "right edge", "cut on the left", "cut on the right"])
def test_words_at_the_edge_of_a_context(spark, at):
    """The word is the text's first or last one, fills the window's last characters, or is one character beyond them."""
    rng = random.Random(5)
    filler = lambda n: " ".join(f"word{rng.randrange(60)}" for _ in range(40))[:n].rsplit(" ", 1)[0].ljust(n, ".")
    name, room = "Zanzibarian", pii.CONTEXT - len("Zanzibarian") - 1
    make = {
        "first": lambda: f"{name} jo@example.org {filler(120)}",
        "last": lambda: f"{filler(120)} jo@example.org {name}",
        "left edge": lambda: f"{filler(120)} {name} {filler(room - 1)} jo@example.org {filler(120)}",
        "right edge": lambda: f"{filler(120)} jo@example.org {filler(room - 1)} {name} {filler(120)}",
        "cut on the left": lambda: f"{filler(120)} {name} {filler(room)} jo@example.org {filler(120)}",
        "cut on the right": lambda: f"{filler(120)} jo@example.org {filler(room)} {name} {filler(120)}",
    }[at]
    rows = [(i, make()) for i in range(6)] + [(i, filler(90)) for i in range(6, 60)]
    got = [r.n_term for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [0 if at.startswith("cut") else 1] * 6 + [0] * 54


def test_sanitised_documents(spark):
    rows = [(1, "call +1 (462) 555-7216 or 4111 1111 1111 1111, 10.0.0.1 x@y.z"), (2, "nothing here"), (3, None), (4, "")]
    got = [tuple(r) for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == [(1, "call [PHONE] or [CARD], [IP] [EMAIL]"), (2, "nothing here"), (3, None), (4, "")]


MAILS = [
    (1, 0, "user", "Shall we meet on Monday?\nI could also come later."),
    (1, 1, "assistant", "On 3 May A wrote:\n> Shall we meet on Monday?\nYes, gladly."),
    (1, 2, "user", "> > shall WE meet on monday\n> Yes, gladly.\nGood.\n>Never said."),
    (1, 3, "assistant", "Another subject."),
    (1, 4, "user", "> Shall we meet on Monday?\n> I could also come later.\n> Unknown line.\nBack to this."),
    (1, 6, "user", ">> Another subject.\n\n> Good.\nSo."),
    (2, 0, "user", None),
    (2, 1, "assistant", ""),
    (2, 1, "assistant", ""),
    (2, 2, "user", "> Shall we meet on Monday?"),
    (2, 3, "user", ">\n> !!\n   > x"),
    (None, None, "user", "> x"),
]


@pytest.fixture(scope="module")
def mails(spark):
    return spark.createDataFrame([(*m, "extra") for m in MAILS], "conv_id long, turn long, role string, text string, origin string")


def test_quotations(mails, oracle):
    rows = {(r.conv_id, r.turn): r for r in quotes.linked(mails).collect()}
    assert rows[1, 1].own_text == "Yes, gladly." and rows[1, 1].parent_turn == 0
    assert (rows[1, 2].own_text, rows[1, 2].parent_turn, rows[1, 2].n_quotes, rows[1, 2].n_linked, rows[1, 2].max_level) == ("Good.", 1, 3, 2, 2)
    assert rows[1, 3].parent_turn == 2 and rows[1, 0].parent_turn is None
    assert (rows[1, 4].parent_turn, rows[1, 4].n_linked) == (0, 1)
    assert rows[1, 6].parent_turn == 2 and rows[1, 6].own_text == "So."
    assert rows[2, 2].n_linked == 0 and rows[2, 2].parent_turn == 1
    df = quotes.with_chats(mails)
    assert len(df.collect()) == len(MAILS)
    got = (sorted(df.columns), rows_of(df.columns, df.collect()))
    assert got == oracle(queries.OP8, {"conversations": mails.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})})


def test_conversations(mails):
    chat = {(r.conv_id, r.span, r.piece): r.chat for r in quotes.formatted(mails).collect()}
    assert chat[1, 0, 0].count("<|end|>") == 6 and ">" not in re.sub(r"<\|\w+\|>", "", chat[1, 0, 0]) and chat[2, 0, 0].count("<|assistant|>") == 2
    assert {(r.conv_id, r.span, r.piece): r.chat_sha256 for r in quotes.with_chats(mails).collect()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in chat.items()}


def test_long_conversations(spark):
    """Many quoted lines in one message, many turns, many messages in one turn."""
    rows = [(1, t, "user", f"message {t}") for t in range(150)] + [(2, 0, "user", f"again {i % 90}") for i in range(130)]
    rows += [(3, 0, "user", "\n".join(f"line {i}" for i in range(5000))), (3, 1, "user", "\n".join(f"{'>' * (1 + i % 2)} line {i}" for i in range(5000)) + "\nreply")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = quotes.formatted(df).collect()
    sizes = sorted((r.conv_id, r.chat.count("<|end|>")) for r in parts)
    assert sizes == [(1, 22), (1, 64), (1, 64), (2, 2), (2, 64), (2, 64), (3, 2)]
    last = quotes.linked(df.where("conv_id = 3")).where("turn = 1").first()
    assert (last.own_text, last.n_quotes, last.n_linked, last.max_level) == ("reply", 5000, 5000, 2)


def test_empty_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quotes.with_chats(none).count() == quotes.formatted(none).count() == 0


def test_conversations_of_the_table(spark, oracle):
    df = queries.op8_quotations(spark, DATA)
    assert (sorted(df.columns), rows_of(df.columns, df.collect())) == oracle(queries.OP8)


@pytest.mark.parametrize("query", [queries.op4_personal_data, queries.op8_quotations, queries.op9_decontamination])
def test_native_operators_use_no_python(spark, query):
    plan = query(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
