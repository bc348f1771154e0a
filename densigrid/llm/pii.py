"""Information-theoretic sanitisation of personal data, in DataFrame operations alone.

Protected entities are e-mail addresses, IP addresses, card and phone numbers found by pattern (``BASE``; matches that fail
their check are dropped).  Words can give an entity away as well: the corpus tells how strongly.  For an entity e and a
word t near it (CONTEXT characters to either side),

    IC(e) = -log2 p(e)      IC(e | t) = -log2 p(e | t)      PMI(e, t) = IC(e) - IC(e | t)      disclosure = PMI / IC(e)

where p(e) is the share of documents with e, and p(e | t) the share of the documents with t that have it near e, shrunk
by c / (c + PRIOR) as it is known from only c distinct contexts; copies with the same context count once there, so repeats
of a text do not make evidence.  IC(e | t) is what a reader of t still lacks to know e, in bits, whatever the size of the
corpus.  A word discloses e if it reveals DISCLOSED of IC(e) or more and leaves GENERALISE bits or less, and if that is no
chance: given that it stands beside e once, the other documents with t, documents(t) - 1, would be beside e as often as c - 1
times or more with a probability of at most the binomial tail for p(e).  That is bounded from above by
(documents(t) - 1)^k p(e)^k / k! with k = c - 1, and must be CHANCE at most; so one context is never evidence, and a word
that the corpus has only once is left alone whatever stands beside it.  A disclosing word that leaves REMOVE bits or less is removed from the
texts that have it near e, wherever it stands in them; the others are generalised to their kind.

A name can also be tied to an entity by form: a word near an e-mail address that is one of the words of its local part
is generalised, without any counts.

Spans are code-point ranges ``kind:start:end``, end exclusive, by kind (email, ip, card, phone, term), then start.  A null
text is an empty one and has none; sanitising leaves null texts null, and texts without entities as they are.  Repeated
rows each get their spans; an empty table gives no rows, and columns of any name come back as they were.
"""

from __future__ import annotations

from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from densigrid.llm.ship import cut, let, quoted, small, text_id

#: Fixed patterns.  In front of two of them stands a guard that only skips starts inside a run of the pattern's first
#: characters, where no leftmost match can start; possessive loops keep the matcher's stack flat.  Neither changes a match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

CONTEXT = 80
#: Weight of doubt, in contexts, and bits that a word may leave of an entity to be generalised, or removed.
PRIOR = 1.0
GENERALISE, REMOVE = 1.0, 0.6
#: Share of an entity's information that a disclosing word reveals at least, and how probable its company with it may be by chance.
DISCLOSED, CHANCE = 0.8, 0.01
#: Matches of a text whose places are added up together.
RUN = 128

_WORD = r"[\p{L}\p{N}]{4,}"
_NAME = r"\p{L}{4,}"
_SPAN = "struct<start:int,end:int,text:string>"


def located(text: Column, pattern: Column) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, text>>: what is between them gives their places.

    Lengths are added up in runs of RUN matches and then over the runs, so that long lists are not copied for each match.
    """
    parts = F.filter(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m"))), lambda x: x["m"].isNotNull())
    runs = lambda all_parts: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_parts) - 1) / RUN).cast("int")), lambda i: F.slice(all_parts, i * RUN + 1, RUN))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("text")))).alias("out"))

    def joined(counted: Column) -> Column:
        """Each run's places, moved by the length of those before it."""
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        moves = F.aggregate(counted, first, lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        moved = lambda by: lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["text"].alias("text"))
        return F.flatten(F.zip_with(counted, moves, lambda r, by: F.transform(r["out"], moved(by))))

    none = F.array().cast(f"array<{_SPAN}>")
    return let(parts, lambda all_parts: F.when(F.size(all_parts) == 0, none).otherwise(let(F.transform(runs(all_parts), lambda run: F.aggregate(run, start, step)), joined)))


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: F.when(F.length(q) <= 3, q.cast("int") <= 255).otherwise(False)))
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    return F.length(digits).between(9, 15)


def base_spans(kind: str, text: Column) -> Column:
    may = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]"), "phone": text.rlike(r"\+[0-9]")}[kind]
    found = F.filter(located(text, F.lit(BASE[kind])), lambda s: passes(kind, s["text"]))
    return F.when(may, found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def scanned(docs: DataFrame, *others: str) -> DataFrame:
    """Columns ``others``, the text (null: empty), its hash, and the base spans of each kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*others, text.alias("text"), text_id(text).alias("text_hash"))
    return rows.select("*", *[base_spans(k, F.col("text")).alias(k) for k in BASE])


def has_entity() -> Column:
    return reduce(lambda a, b: a | b, [F.size(k) > 0 for k in BASE])


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """text_hash, terms: array<struct<term, remove>> of the texts that hold an entity and words that disclose it."""
    entities = scanned(docs).where(has_entity()).withColumn("row", F.monotonically_increasing_id())
    # The words of an e-mail address's local part go with it.
    form = lambda kind, s: F.regexp_extract_all(F.substring_index(F.lower(s["text"]), "@", 1), F.lit(_NAME), 0) if kind == "email" else F.array().cast("array<string>")
    entity = lambda kind: lambda s: F.struct(F.xxhash64(F.lit(kind), F.lower(s["text"])).alias("e"), s["start"].alias("start"), s["end"].alias("end"), form(kind, s).alias("form"))
    spans = F.concat(*[F.transform(k, entity(k)) for k in BASE])
    each = entities.select("row", "text_hash", "text", F.explode(spans).alias("s"))
    # One character more than the context on either side, where the text has it: a run of letters and digits that begins
    # with it on the left, or ends with it on the right, is a word that the edge cuts, which is no word of the context.
    before = F.substring("text", F.greatest(F.lit(1), F.col("s.start") - CONTEXT), F.least(F.lit(CONTEXT + 1), F.col("s.start")))
    after = F.substring("text", F.col("s.end") + 1, F.lit(CONTEXT + 1))
    whole = lambda part, edge: F.when(F.length(part) > CONTEXT, F.regexp_replace(part, edge, "")).otherwise(part)
    inner = F.concat(whole(before, r"^[\p{L}\p{N}]+"), F.lit(" "), whole(after, r"[\p{L}\p{N}]+$"))
    near = each.select("row", "text_hash", F.col("s.e").alias("e"), F.col("s.form").alias("form"), F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(inner), F.lit(_WORD), 0))).alias("words"))
    near = cut(near.withColumn("context", F.xxhash64(F.array_join("words", " "))))
    if near.isEmpty():
        return near.select("text_hash", F.array(F.struct(F.lit("").alias("term"), F.lit(False).alias("remove"))).alias("terms"))
    # Contexts are counted once each, documents once for an entity and a word.
    beside = near.select("row", "text_hash", "e", "context", "form", F.explode("words").alias("term"))
    pairs = cut(beside.groupBy("e", "term").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("row").alias("both")).where("contexts > 1"))
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Every word of the corpus is counted, partly before the shuffle; the candidates are looked up in the counts (by an
    # inner join: a semi join would be moved below the count).  The other way round, each occurrence of a candidate would be
    # a row, and a larger corpus has more candidates.
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), 0))).alias("term"))
    often = words.groupBy("term").agg(F.count("*").alias("documents")).join(small(pairs.select("term").distinct()), "term")
    having = near.select("row", "e").distinct().groupBy("e").agg(F.count("*").alias("having"))
    counted = pairs.join(small(often), "term").join(small(having.join(pairs.select("e").distinct(), "e", "left_semi")), "e")
    told = small(counted.select("e", "term", *[v.alias(n) for n, v in disclosure(docs.count()).items()]).where((F.col("bits") <= GENERALISE) & (F.col("disclosed") >= DISCLOSED) & (F.col("log_chance") <= log2(CHANCE))))
    # By entity and word together: an entity that very many texts hold does not bring each of them the words of all others.
    asked = beside.groupBy("text_hash", "e", "term").agg(F.max(F.array_contains("form", F.col("term"))).alias("formed"))
    met = asked.join(told.select("e", "term", "bits"), ["e", "term"], "left").where("formed OR bits IS NOT NULL")
    terms = met.groupBy("text_hash", "term").agg(F.max(F.coalesce(F.col("bits") <= REMOVE, F.lit(False))).alias("remove"))
    return terms.groupBy("text_hash").agg(F.array_sort(F.collect_list(F.struct("term", "remove"))).alias("terms"))


def disclosure(documents: int) -> dict[str, Column]:
    """Of counts (having: documents with the entity, documents: with the word, both, contexts) in a corpus of so many documents: bits that
    the word leaves of the entity, share of its information that the word reveals (0 where all documents have the entity), and
    log2 of the bound on the probability of so many contexts by chance."""
    ic = -F.log2(F.col("having") / F.lit(float(documents)))
    bits = -F.log2(F.col("both") / F.col("documents") * F.col("contexts") / (F.col("contexts") + PRIOR))
    k = F.col("contexts") - 1
    factorial = F.aggregate(F.sequence(F.lit(1), F.least(k, F.lit(64))), F.lit(0.0), lambda a, i: a + F.log2(i.cast("double")))  # beyond 64 a smaller divisor: still a bound
    chance = k * (F.log2(F.greatest(F.col("documents") - 1, F.lit(1)).cast("double")) - ic) - factorial
    return {"bits": bits, "disclosed": F.when(ic > 0, (ic - bits) / ic).otherwise(0.0), "log_chance": F.least(chance, F.lit(0.0))}


def with_terms(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Scanned rows and, in the column ``term``, the spans of disclosing words that do not touch a base span."""
    told = small(disclosing_terms(docs).select(F.col("text_hash").alias("told_hash"), "terms"))
    joined = rows.join(told, F.col("text_hash") == F.col("told_hash"), "left").drop("told_hash")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform("terms", lambda t: t["term"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    found = F.when(F.col("terms").isNotNull(), located(F.col("text"), pattern)).otherwise(F.array().cast(f"array<{_SPAN}>"))
    all_base = F.concat(*BASE)
    return joined.withColumn("term", F.filter(found, lambda s: ~F.exists(all_base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))


def written(kind: str) -> Column:
    return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term of every row."""
    rows = with_terms(scanned(docs, "doc_id"), docs)
    base = F.concat(*[written(k) for k in BASE])
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, written("term")), ",").alias("spans"),
        F.size("term").cast("long").alias("n_term"),
    )


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with entities replaced by their kind, and disclosing words generalised or removed; n_chars follows.

    Spans that overlap are replaced as one, by the label of the first.
    """
    columns = docs.columns
    rows = scanned(docs, *[F.col(quoted(c)).alias(f"__{c}") for c in columns])
    rows = with_terms(rows, docs)
    removed = lambda s: F.exists("terms", lambda t: (t["term"] == F.lower(s["text"])) & t["remove"])
    label = lambda s: F.when(removed(s), F.lit("")).otherwise(F.when(s["text"].rlike("^[0-9]"), F.lit("[NUMBER]")).otherwise(F.lit("[WORD]")))
    labelled = lambda by: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), by(s).alias("label"))
    fixed = lambda kind: lambda s: F.lit(LABELS[kind])
    marked = F.concat(*[F.transform(k, labelled(fixed(k))) for k in BASE], F.transform("term", labelled(label)))
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["label"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, more).otherwise(acc["out"]).alias("out"))

    rebuilt = F.aggregate(
        F.array_sort(marked),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        step,
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    changed = F.when(F.col("__text").isNull(), F.lit(None).cast("string")).when(has_entity(), rebuilt).otherwise(text)
    out = rows.select(*[F.col(quoted(f"__{c}")).alias(c) if c != "text" else changed.alias("text") for c in columns])
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
