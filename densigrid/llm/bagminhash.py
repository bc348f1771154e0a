"""Near-duplicates of documents by weighted-Jaccard signatures (BagMinHash), banding and verified multiset overlap.

A text is a multiset of shingles: each run of five words (lower case, parted by white space), or all words where there
are fewer.  Two texts are linked if the weighted Jaccard similarity of their multisets (sum of minima over sum of maxima)
is 0.8 or more; a class is a connected component of links, named by its least doc_id (null only if all its ids are null).

Signatures.  Each shingle carries Poisson processes over its weight axis: one for each weight range [0,1), [1,2), [2,4),
[4,8) ..., of a rate equal to the range's width.  A process gives its first point, which falls on a random component of the signature;
a range wider than one is then split in halves, one of which keeps the point while the other draws its own later one,
so ranges beyond a text's weight are left early, and ranges whose point is later than the largest minimum so far are
dropped.  What a shingle draws depends on the shingle and the range alone.  The least point of each component below the
text's weights is its signature: two texts agree in a component with a probability equal to their similarity.

Steps, all of them distributed.  Rows with the same word list are one text (``text_key``); each distinct text has one
signature and a row for each band.  Each bucket of a band gets a leader, the member that meets most texts over all its
buckets; a group of near copies so has the same leader in nearly all its buckets.  Each member is compared with its
leaders.  Members that are linked to a leader are settled with each other; the others (strays) are compared with all
members of their leader that can be near them: 1 - similarity is a metric, so two texts whose distances to the leader
differ by more than 0.2 are not linked.  Strays meet members in blocks (``blocks_of``): whole texts are sent once for
each block, blocks are tested inside a task, and only links leave it, so no pair is ever a row and no link is lost.
Groups without strays cost one comparison for each member; strays near the threshold cost one with each near member.

Null and empty texts have no words; they are one class.  Repeated rows and ties are in one class.  An empty table gives
no rows.  The chance to miss a pair of similarity 0.8 by banding is (1 - 0.8**ROWS)**BANDS, 0.04 %, and less above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densigrid.llm.bpe import Memo
from densigrid.llm.ship import cut, fresh, map_texts, quoted, ship, small

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 20, 5
SIZE = BANDS * ROWS

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five word hashes, in order; of the whole list where it is shorter; none of no words."""
    n = min(SHINGLE, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out * _MULTIPLY + words[k : len(words) - n + 1 + k])
    return out


class Shingler:
    def __init__(self):
        self.memo = Memo(lambda w: word_hash(w).to_bytes(8, "little"), 300_000)

    def words(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, text.lower().split())), np.uint64)

    def multiset(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(shingle_hashes(self.words(text)), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets given as sorted values and counts; 1 for two empty ones."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    return shared / (total - shared)


def signatures(values: np.ndarray, weights: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """Signatures of many multisets at once: ``owner[i]`` is the multiset that holds ``values[i]`` ``weights[i]`` times.

    Gives, for each multiset and component, the name of the process point of least time (all ones if there is none).
    """
    out = np.full((owners, SIZE), ~np.uint64(0))
    if not len(values):
        return out
    # Ranges [low, low + width) of each value: [0,1), then [2**k, 2**(k+1)) up to its weight.
    parts, edge, size, alive = [], 0, 1, np.arange(len(values))
    while len(alive):
        with np.errstate(over="ignore"):
            seed = values[alive] ^ mix(np.full(1, edge + 1, np.uint64) * _MULTIPLY)
        parts.append((owner[alive], np.full(len(alive), edge), np.full(len(alive), size), seed, weights[alive]))
        edge, size = edge + size, edge + size
        alive = alive[weights[alive] > edge]
    own, low, width, seed, most = map(np.concatenate, zip(*parts))
    seed, at = drawn(seed, np.zeros(len(own)), width)
    # Points later than a time by which the signature is surely full change nothing: try that first, and all where it is not.
    rates = np.bincount(owner, weights, owners)
    early = np.where(rates > 4 * SIZE, 1.8 * SIZE * np.log(SIZE) / np.maximum(rates, 1), np.inf)
    for last in (early, np.full(owners, np.inf)):
        go = at <= last[own]
        names, times = walk(own[go], low[go], width[go], seed[go], most[go], at[go], owners)
        full = times.max(1) <= last
        full |= np.isinf(last)
        mine = full & (out[:, 0] == ~np.uint64(0))
        out[mine] = names[mine]
        left = ~full
        if not left.any():
            break
        own, low, width, seed, most, at = (x[left[own]] for x in (own, low, width, seed, most, at))
    return out


def drawn(seed: np.ndarray, at: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next point of each process: its name, of which the low bits choose a component, and its time."""
    with np.errstate(over="ignore"):
        seed = mix(seed + _MULTIPLY)
    return seed, at - np.log(((seed >> np.uint64(24)).astype(np.float64) + 1) / (1 << 40)) / width


def walk(own, low, width, seed, most, at, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Follow processes whose first points are drawn until none can still give a least point."""
    times, names = np.full(owners * SIZE, np.inf), np.full(owners * SIZE, ~np.uint64(0))
    while len(own):
        part = own * SIZE + ((seed & np.uint64(0xFFFFFF)) % np.uint64(SIZE)).astype(np.int64)
        inside = np.flatnonzero(low + width <= most)  # the whole range counts: its point may stand in the signature
        spot, time = part[inside], at[inside]
        better = time < times[spot]
        spot, time, inside = spot[better], time[better], inside[better]
        np.minimum.at(times, spot, time)
        first = times[spot] == time
        names[spot[first]] = seed[inside[first]]
        go = at < times.reshape(-1, SIZE).max(1)[own]
        own, low, width, seed, most, at = (x[go] for x in (own, low, width, seed, most, at))
        # Single ranges draw again; wider ones are split, and one half keeps the point.
        wide = width > 1
        one = ~wide
        next_seed, next_at = drawn(seed[one], at[one], width[one])
        if not wide.any():
            seed, at = next_seed, next_at
            continue
        half = width[wide] // 2
        with np.errstate(over="ignore"):
            upper = (mix(seed[wide] ^ mix(low[wide].astype(np.uint64) + np.uint64(7))) & np.uint64(1)).astype(bool)
            keeps, other = low[wide] + np.where(upper, half, 0), low[wide] + np.where(upper, 0, half)
            fresh = mix(seed[wide] ^ mix(other.astype(np.uint64) * _MULTIPLY + half.astype(np.uint64)))
        fresh, fresh_at = drawn(fresh, at[wide], half)
        own, most = (np.concatenate([x[one], x[wide], x[wide]]) for x in (own, most))
        at, seed = np.concatenate([next_at, at[wide], fresh_at]), np.concatenate([next_seed, seed[wide], fresh])
        low, width = np.concatenate([low[one], keeps, other]), np.concatenate([width[one], half, half])
        near = low < most
        own, low, width, seed, most, at = (x[near] for x in (own, low, width, seed, most, at))
    return names.reshape(owners, SIZE), times.reshape(owners, SIZE)


def bands_of(names: np.ndarray) -> np.ndarray:
    """One hash for each band of a signature."""
    out = np.zeros((len(names), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            out = mix(out * _MULTIPLY + names.reshape(len(names), BANDS, ROWS)[:, :, r])
    return out


def text_bands(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep``, ``text_key`` (hash of the word list) and ``bands``, array<long> of BANDS hashes, of each row."""

    def make():
        shingler = Shingler()

        def work(texts: list[str]) -> dict:
            import xxhash

            words = [shingler.words(t) for t in texts]
            keys = [xxhash.xxh3_128_digest(w.tobytes()) for w in words]
            place = {k: i for i, k in reversed(list(enumerate(keys)))}
            order = sorted(place.values())  # equal texts of a batch are signed once
            sets = [np.unique(shingle_hashes(words[i]), return_counts=True) for i in order]
            values = np.concatenate([s[0] for s in sets])
            weights = np.concatenate([s[1] for s in sets]).astype(np.int64)
            bands = bands_of(signatures(values, weights, np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets]), len(sets)))
            row = {order[i]: i for i in range(len(order))}
            all_bands = bands[[row[place[k]] for k in keys]].view(np.int64)
            return {
                "text_key": pa.array(keys, pa.binary()),
                "bands": pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) * BANDS + 1, BANDS), pa.int32()), pa.array(all_bands.ravel())),
            }

        return work

    return map_texts(docs, make, "text_key binary, bands array<long>", keep)


def by_merge(df: DataFrame) -> DataFrame:
    """Joined by sorting: this side grows with the corpus, so it is never gathered on the driver to be broadcast, however
    small it is now; parts of a hot key can be split."""
    return df.hint("merge")


def link_key(name: str):
    """The same value by another expression: a join on it gets an exchange of its own, whose large parts Spark can split."""
    return F.col(name) + 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root of the connected components of undirected links; the root is the least node.

    Large-star and small-star steps in turn, until all components are stars.  Each link is moved as often as there are rounds
    (logarithmic in the size of a component), nodes with many links are aggregated before they are shuffled.
    """
    def star(links: DataFrame) -> DataFrame:
        least = links.groupBy("u").agg(F.min("v").alias("m")).select(link_key("u").alias("k"), F.least(F.col("u"), F.col("m")).alias("m"))
        return links.join(by_merge(least), F.col("u") == F.col("k")).select("u", "v", "m")

    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while not stars(now):
        large = star(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        small = star(large.distinct())
        now = cut(small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def stars(links: DataFrame) -> bool:
    """Whether each node is either a root or has one link, which leads to a root."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up > 1 or (up = 1 and low = 1)").isEmpty()


#: Members that one copy of a leader's text is compared with in the first step.
SALTED = 500
#: Members, and words, of a block of the second step.
BLOCK_ROWS, BLOCK_WORDS = 500, 1_000_000
#: Distance up to which texts are linked, with room for rounding, and cells of distance to the leader.
NEAR, CELLS = 1 - SIMILAR + 1e-9, 10


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), and two hashes of both, which together name a row among those that differ from it."""
    text, doc = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("string")
    return docs.select("doc_id", text.alias("text"), *row_hashes(text, doc))


def row_hashes(text, doc) -> list:
    return [F.xxhash64(text, doc).alias("h1"), F.xxhash64(F.lit("second"), doc, text).alias("h2")]


def leaders_of(texts: DataFrame) -> DataFrame:
    """leader, id: distinct pairs of texts (id, bands) and the leaders of their buckets."""
    rows = texts.select("id", F.posexplode("bands").alias("band", "hash")).select("id", F.xxhash64("band", "hash").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(rows.join(by_merge(buckets).select(link_key("bucket").alias("k"), "n"), F.col("bucket") == F.col("k")).drop("k"))
    # A member's rank: texts met in all its buckets, then a hash of the id, in one number.
    met = F.least(F.sum("n"), F.lit((1 << 24) - 1))
    ranks = members.groupBy("id").agg(met.alias("met")).select(F.col("id").alias("i"), (F.shiftleft("met", 39) + F.xxhash64("id").bitwiseAND(F.lit((1 << 39) - 1))).alias("rank"))
    best = members.join(by_merge(ranks), F.col("id") == F.col("i")).groupBy("bucket").agg(F.max_by("id", "rank").alias("leader"))
    pairs = members.join(by_merge(best).select(link_key("bucket").alias("k"), "leader"), F.col("bucket") == F.col("k"))
    return pairs.where("id <> leader").select("leader", "id").distinct()


def with_texts(source: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (id, ...) with text_key and text: of each text one row of the documents is read."""
    asked = small(wanted.join(by_merge(texts.select(F.col("id").alias("i"), "h1", "text_key")), F.col("id") == F.col("i")).drop("i"))
    return source.select("h1", "text").join(asked, "h1").drop("h1")


class Reader:
    """Multisets of rows (text, text_key); None for a text that is not the one of the key (equal 64-bit hashes)."""

    def __init__(self):
        self.shingler = Shingler()

    def __call__(self, text: str, key: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        import xxhash

        words = self.shingler.words(text)
        return np.unique(shingle_hashes(words), return_counts=True) if xxhash.xxh3_128_digest(words.tobytes()) == key else None


def with_leaders(source: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """leader, id, similar, words: every pair of ``pairs`` (leader, id) compared by whole multisets."""
    salts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("salts"))
    members = pairs.join(by_merge(salts.select(link_key("leader").alias("k"), "salts")), F.col("leader") == F.col("k")).select("leader", "id", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"), F.lit(1).alias("kind"))
    heads = salts.select("leader", F.col("leader").alias("id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"))
    rows = with_texts(source, texts, members.unionByName(heads)).repartition("leader", "salt").sortWithinPartitions("leader", "salt", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, place, head, last = Reader(), None, None, None
        for batch in batches:
            out = []
            for leader, salt, kind, i, key, text in zip(*(batch.column(n).to_pylist() for n in ("leader", "salt", "kind", "id", "text_key", "text"))):
                if (leader, salt) != place:
                    place, head, last = (leader, salt), None, None
                if i == last or (kind == 0 and head is not None):  # the row is there more than once
                    continue
                own = read(text, key)
                if own is None:
                    continue
                if kind == 0:
                    head = own
                elif head is not None:
                    last = i
                    out.append((leader, i, similarity(head, own), int(own[1].sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["leader", "id", "similar", "words"])

    ship(source.sparkSession)
    return rows.mapInArrow(run, "leader long, id long, similar double, words long")


def blocks_of(met: DataFrame) -> DataFrame:
    """leader, cell, tb, qb, role, id: which members meet which strays, in blocks of bounded size.

    ``met`` (leader, id, similar, words).  Role 1 is met, 2 meets, 3 both.  Of a leader with few members, all that can be near
    a stray are one block.  Of others, members stand in the cell of their distance to the leader, strays go to all cells that
    can hold texts near them, and the two sides of a cell are split into blocks that meet in all combinations.
    """
    apart = met.select("leader", "id", "words", (1 - F.col("similar")).alias("d"), (F.col("similar") < SIMILAR).alias("stray"))
    stray = F.col("stray")
    groups = apart.groupBy("leader").agg(F.count("*").alias("n"), F.sum("words").alias("all_words"), F.min(F.when(stray, F.col("d"))).alias("nearest")).where("nearest IS NOT NULL")
    # Both sides by another expression than what is grouped next, so the parts of a large group can be split.
    found = apart.withColumn("l", link_key("leader")).join(by_merge(groups.select(link_key("leader").alias("k"), "n", "all_words", "nearest")), F.col("l") == F.col("k"))
    rows = found.where(F.col("d") >= F.col("nearest") - NEAR).drop("k", "l")
    few = (F.col("n") <= BLOCK_ROWS) & (F.col("all_words") <= BLOCK_WORDS)
    zero = F.lit(0)
    one = rows.where(few).select("leader", F.lit(-1).alias("cell"), zero.alias("tb"), zero.alias("qb"), F.when(stray, 3).otherwise(1).alias("role"), "id")
    own_cell = F.least(F.floor(F.col("d") * CELLS).cast("int"), F.lit(CELLS - 1))
    many = rows.where(~few).select("leader", "id", "words", own_cell.alias("own"), "stray")
    reach = int(np.ceil(NEAR * CELLS))
    queries = many.where("stray").select("leader", "id", "words", F.explode(F.sequence(F.greatest(zero, F.col("own") - reach), F.least(F.lit(CELLS - 1), F.col("own") + reach))).alias("cell"), F.lit(2).alias("role"))
    both = many.select("leader", "id", "words", F.col("own").alias("cell"), F.lit(1).alias("role")).unionByName(queries)
    count = lambda role: F.ceil(F.greatest(F.sum((F.col("role") == role).cast("int")) / BLOCK_ROWS, F.sum(F.when(F.col("role") == role, F.col("words"))) / BLOCK_WORDS)).cast("int")
    sizes = both.groupBy("leader", "cell").agg(count(1).alias("p"), count(2).alias("q")).where("p > 0 AND q > 0")
    sized = both.join(by_merge(sizes.select(link_key("leader").alias("k"), F.col("cell").alias("c"), "p", "q")), (F.col("leader") == F.col("k")) & (F.col("cell") == F.col("c")))
    upto = lambda n: F.sequence(zero, F.col(n) - 1)
    place = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    met_by = sized.where("role = 1").select("leader", "cell", place("p").alias("tb"), F.explode(upto("q")).alias("qb"), "role", "id")
    meet = sized.where("role = 2").select("leader", "cell", F.explode(upto("p")).alias("tb"), place("q").alias("qb"), "role", "id")
    return one.unionByName(met_by).unionByName(meet)


class Block:
    """Multisets that others are compared with, all at once."""

    def __init__(self, ids: list[int], sets: list[tuple[np.ndarray, np.ndarray]]):
        self.ids = ids
        self.values, self.at = np.unique(np.concatenate([s[0] for s in sets]), return_inverse=True)
        self.counts = np.concatenate([s[1] for s in sets])
        self.starts = np.cumsum([0, *[len(s[0]) for s in sets]])[:-1]
        self.totals = np.add.reduceat(self.counts, self.starts)

    def near(self, own: tuple[np.ndarray, np.ndarray]) -> list[int]:
        """Ids of similarity 0.8 or more to a multiset."""
        where = np.minimum(np.searchsorted(self.values, own[0]), len(self.values) - 1)
        hit = self.values[where] == own[0]
        weight = np.zeros(len(self.values), np.int64)
        weight[where[hit]] = own[1][hit]
        shared = np.add.reduceat(np.minimum(weight[self.at], self.counts), self.starts)
        return [self.ids[k] for k in np.flatnonzero(shared / (self.totals + int(own[1].sum()) - shared) >= SIMILAR)]


def near_strays(source: DataFrame, texts: DataFrame, blocks: DataFrame) -> DataFrame:
    """a, b: links of strays, enough of them to connect whatever is linked within a block."""
    keys = ["leader", "cell", "tb", "qb"]
    later = (F.col("role") == 2).cast("int").alias("later")
    rows = with_texts(source, texts, blocks).withColumn("later", later).repartition(*keys).sortWithinPartitions(*keys, "later", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader()
        place, block, ids, sets, asking, last, parent = None, None, [], [], [], None, {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def links(i, own):
            for j in block.near(own):
                a, b = root(i), root(j)
                if a != b:
                    parent[a] = b
                    yield i, j

        def loaded():
            """The block is complete: its own strays ask first."""
            nonlocal block
            out = []
            if block is None and ids:
                block = Block(ids, sets)
                for k in asking:
                    out += links(ids[k], sets[k])
            return out

        for batch in batches:
            out = []
            for *key, role, i, text_key, text in zip(*(batch.column(n).to_pylist() for n in (*keys, "role", "id", "text_key", "text"))):
                if key != place:
                    out += loaded()
                    place, block, ids, sets, asking, last, parent = key, None, [], [], [], None, {}
                if (role, i) == last:  # the row is there more than once
                    continue
                own = read(text, text_key)
                if own is None:
                    continue
                last = (role, i)
                if role == 2:
                    out += loaded()
                    if block is not None:
                        out += links(i, own)
                else:
                    if role == 3:
                        asking.append(len(ids))
                    ids.append(i)
                    sets.append(own)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])
        out = loaded()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])

    ship(source.sparkSession)
    return rows.mapInArrow(run, "a long, b long")


def linked_texts(source: DataFrame, texts: DataFrame) -> DataFrame:
    """node, root over ids of distinct texts (id, text_key, h1, bands): components of links of 0.8 or more."""
    pairs = cut(leaders_of(texts))
    met = cut(with_leaders(source, texts, pairs))
    links = met.where(F.col("similar") >= SIMILAR).select(F.col("leader").alias("a"), F.col("id").alias("b"))
    return components(links.unionByName(near_strays(source, texts, blocks_of(met))))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, h1, h2 (see ``numbered``) and class_key of every row of documents (doc_id, text); one row for each row."""
    source = numbered(docs)
    rows = cut(text_bands(source, ["doc_id", "h1", "h2"]))
    # Distinct texts get numbers, which are final as they are written; numbers aggregate and join faster than keys.
    texts = cut(rows.groupBy("text_key", "bands").agg(F.min("doc_id").alias("doc_id"), F.min("h1").alias("h1")).withColumn("id", F.monotonically_increasing_id()))
    roots = linked_texts(source, texts)
    rooted = cut(texts.select("id", "text_key", "doc_id").join(by_merge(roots), F.col("id") == F.col("node"), "left").select("text_key", "doc_id", F.coalesce("root", "id").alias("class_key")))
    named = rooted.groupBy("class_key").agg(F.min("doc_id").alias("class_id"))
    keys = rooted.select("text_key", "class_key").join(by_merge(named.select(link_key("class_key").alias("k"), "class_id")), F.col("class_key") == F.col("k")).drop("k")
    return rows.select("doc_id", "h1", "h2", "text_key").join(by_merge(cut(keys)), "text_key").select("doc_id", "class_id", "h1", "h2", "class_key")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each class the row whose doc_id names it (one of them, if it is repeated)."""
    narrow = cut(classes(docs))
    names = F.col("doc_id").eqNullSafe(F.col("class_id"))
    best = narrow.where(names).groupBy("class_key").agg(F.min("h1").alias("best"), F.count("*").alias("copies"))
    marked = narrow.join(by_merge(best.select(link_key("class_key").alias("k"), "best", "copies")), F.col("class_key") == F.col("k"))
    keep = names & (F.col("h1") == F.col("best"))
    drops = small(marked.where(~keep | (F.col("copies") > 1)).select("h1", "h2", keep.alias("keep")).distinct())
    h1, h2 = fresh(docs, "h1"), fresh(docs, "h2")
    hashes = row_hashes(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("string"))
    keyed = docs.withColumns({h1: hashes[0], h2: hashes[1]})
    on = (keyed[h1] == drops["h1"]) & (keyed[h2] == drops["h2"])
    kept = keyed.join(drops, on, "left_anti")
    again = drops.where("keep")
    if not again.isEmpty():  # the row that stands for its class is there more than once
        kept = kept.unionByName(keyed.join(again, on, "left_semi").dropDuplicates([h1, h2]))
    return kept.select(*map(quoted, docs.columns))
