"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece of text exactly one token can stand last in a right encoding of that prefix: the token ``t``
of bytes ``piece[j:i]`` for which the token that stands last in ``piece[:j]`` and ``t`` are left as they are when the
merges run over both.  ``last_tokens`` keeps that token for each prefix, so an encoding is read off backwards, appended
bytes only extend the list, and after an edit only the prefixes near it change.

Texts are first cut into matches of a pattern, as rank-file vocabularies ask for; a null text is an empty text and an
empty text has no tokens.  Very long pieces cost time in proportion to their length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from densigrid.llm.ship import kept, map_texts

#: Words and pairs that a Python worker remembers at most, twice over, and the longest of them: so its memory is bounded, also
#: where texts have no spaces and each "word" is a whole text.
REMEMBERED, LONGEST = 250_000, 64

#: Beginnings of so many bytes, twice that, ... HEADS times that are remembered with their last tokens: many words share them.
HEAD, HEADS = 4, 8

# A cut is safe before a single space with a visible character after it: no match of the pattern crosses it.
_ODD = re.compile(r" (?:\s|$)")
_SAFE = re.compile(r" (?=\S)")


class Memo(dict):
    """A dict that fills itself; entries that were not used during a whole generation of ``limit`` entries go, and texts of
    more than LONGEST characters are not kept at all."""

    def __init__(self, make, limit: int = REMEMBERED):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if isinstance(key, str) and len(key) > LONGEST:
            return
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def keep_all(self, values: dict) -> None:
        """``keep`` of texts, all at once; so one generation may exceed its limit by these."""
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self.update(values if max(map(len, values), default=0) <= LONGEST else {k: v for k, v in values.items() if len(k) <= LONGEST})


def spaced_words(text: str) -> tuple[str, list[str]]:
    """The text up to its first safe cut, and what follows each cut without its space."""
    parts = text.split(" ") if not _ODD.search(text) else _SAFE.split(text)
    return parts[0], parts[1:]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.names = [str(i) for i in range(len(self.tokens))]
        self.longest = max(map(len, ranks))
        self.matches = regex.compile(pattern).findall
        self.stays = Memo(lambda t: self.merged(self.tokens[t]) == [t])
        self.halves = Memo(self._halves, len(self.tokens))
        # Together some 150 MB where all are full.
        self.fits = Memo(self._fit, 300_000)
        self.heads = Memo(lambda h: tuple(self.last_tokens(h)), 50_000)
        self.piece = Memo(lambda m: tuple(self.encode_piece(m)), 60_000)
        self.word = Memo(lambda w: tuple(self.encode_part(" " + w)), 200_000)

    def merged(self, piece: bytes, least: int = 1) -> list[int]:
        """The definition: join the neighbours of lowest rank, leftmost first, until none can be joined (or as many parts as
        ``least`` are left).  For short bytes."""
        parts, find = [piece[i : i + 1] for i in range(len(piece))], self.ranks.get
        pairs = [find(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while len(pairs) >= least and (lowest := min(pairs)) < 1 << 60:
            i = pairs.index(lowest)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = find(parts[i - 1] + parts[i], 1 << 60)
            if i < len(pairs):
                pairs[i] = find(parts[i] + parts[i + 1], 1 << 60)
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose join makes the token last, if they and theirs all have lower ranks: then the joins of its bytes
        are made in the order of ranks.  A single byte has itself twice; None where it is otherwise."""
        if len(self.tokens[token]) == 1:
            return token, token
        parts = self.merged(self.tokens[token], 2)
        return tuple(parts) if len(parts) == 2 and max(parts) < token and all(self.halves[p] for p in parts) else None

    def _fit(self, pair: int) -> bool:
        """Do two tokens, as one number, stay as they are side by side?

        Their joins are undone, the latest first: what then touches at the border must not have been a better join than the
        one undone last.  Tokens out of the order of ranks are joined anew.
        """
        a, b = divmod(pair, len(self.tokens))
        if not (self.halves[a] and self.halves[b]):
            return self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        tokens, find, halves, bound = self.tokens, self.ranks.get, self.halves, 1 << 60
        while find(tokens[a] + tokens[b], bound) >= bound:
            a_byte, b_byte = len(tokens[a]) == 1, len(tokens[b]) == 1
            if a_byte and b_byte:
                return True
            if b_byte or (a > b and not a_byte):
                bound, a = a, halves[a][1]
            else:
                bound, b = b + 1, halves[b][0]  # of equal joins the left one comes first
        return False

    def last_tokens(self, piece: bytes, last: list[int] | None = None) -> list[int]:
        """For each prefix its last token; ``last`` holds those of the first prefixes and is extended in place."""
        if last is None:
            known = max(0, min((len(piece) - 1) // HEAD, HEADS)) * HEAD  # none of an empty piece
            last = list(self.heads[piece[:known]]) if known else []
        find, longest, fits, stays, size = self.ranks.get, self.longest, self.fits, self.stays, len(self.tokens)
        # Only one token can be right, so they may be tried in any order: mostly the last one grows.
        grows = len(last) - len(self.tokens[last[-1]]) if last else 0
        for end in range(len(last) + 1, len(piece) + 1):
            token = find(piece[grows:end])
            if token is None or not (fits[last[grows - 1] * size + token] if grows else stays[token]):
                for grows in range(end - longest if end > longest else 0, end):
                    token = find(piece[grows:end])
                    if token is not None and (fits[last[grows - 1] * size + token] if grows else stays[token]):
                        break
            last.append(token)
        return last

    def edited(self, old: bytes, last: list[int], at: int, cut: int, new: bytes) -> tuple[bytes, list[int]]:
        """The piece with ``cut`` bytes at ``at`` replaced by ``new``, and its last tokens.

        Prefixes before the edit keep theirs.  Behind it, once as many prefixes in a row as the longest token has bytes
        agree with the old ones, all others do.
        """
        piece, shift = old[:at] + new + old[at + cut :], len(new) - cut
        out, same = last[:at], 0
        for end in range(at + 1, len(piece) + 1):
            self.last_tokens(piece[:end], out)
            same = same + 1 if end > at + len(new) and out[-1] == last[end - 1 - shift] else 0
            if same >= self.longest:
                return piece, out + last[end - shift :]
        return piece, out

    def read_off(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[last[end - 1]])
        return out[::-1]

    def encode_part(self, text: str) -> list[int]:
        out: list[int] = []
        for match in self.matches(text):
            out += self.piece[match] if len(match) < 40 else self.encode_piece(match)
        return out

    def encode_piece(self, match: str) -> list[int]:
        piece = match.encode()
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.read_off(self.last_tokens(piece))

    def encode(self, text: str) -> list[int]:
        first, words = spaced_words(text)
        return [*self.encode_part(first), *chain.from_iterable(map(self.word.__getitem__, words))]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class GrowingText:
    """A text that is appended to; only what follows the last safe cut is encoded again."""

    def __init__(self, bpe: PrefixBPE):
        self.bpe, self.done, self.tail = bpe, [], ""

    def append(self, text: str) -> None:
        self.tail += text
        cuts = [m.start() for m in _SAFE.finditer(self.tail)]
        if cuts:
            self.done += self.bpe.encode(self.tail[: cuts[-1]])
            self.tail = self.tail[cuts[-1] :]

    def ids(self) -> list[int]:
        return self.done + self.bpe.encode_part(self.tail)


def load(path: str, pattern: str) -> PrefixBPE:
    """One for each Python worker; it keeps what it remembers from task to task, as long as these encode."""
    return kept(("bpe", path, pattern), lambda: PrefixBPE(read_ranks(path), pattern))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, keep: list[str], with_ids: bool = True, with_hashes: bool = True) -> DataFrame:
    """Columns ``keep``, n_tokens, and on request ids (array<int>), ids_sha256 and decoded_sha256 (of the decoded bytes).

    One narrow pass; repeated rows stay, null texts count as empty.  ``vocabulary`` is a rank file on every machine.
    """
    fields = "n_tokens long" + ", ids array<int>" * with_ids + ", ids_sha256 string, decoded_sha256 string" * with_hashes

    def make():
        bpe = load(vocabulary, pattern)

        def work(texts: list[str]) -> dict:
            n, rows, ids_sha, decoded_sha = [], [], [], []
            for text in texts:
                ids = bpe.encode(text)
                n.append(len(ids))
                if with_ids:
                    rows.append(np.array(ids, dtype=np.int32))
                if with_hashes:
                    ids_sha.append(hashlib.sha256(",".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            out: dict = {"n_tokens": pa.array(n, pa.int64())}
            if with_ids:
                flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(flat))
            if with_hashes:
                out |= {"ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(decoded_sha, pa.string())}
            return out

        return work

    return map_texts(docs, make, fields, keep, keeps=True)
