"""Operator 7: byte-level BPE by prefix dynamic programming.

A byte string's BPE tokens are those whose neighbours are all *valid pairs*
(two tokens that merge back to themselves).  So each prefix has one last token
that can end its encoding: the token t that ends there and forms a valid pair
with the last token of the prefix before t.  ``Prefixes`` stores that token
for each prefix; walking back from the end gives the encoding.  Appending
bytes only adds entries, and an edit recomputes entries from the edit until
they agree with the old ones for as many bytes as the longest token has.

Texts are cut by the tokenizer's pattern first, and each piece is encoded by
itself, as the public tokenizer does.  Work is per row: no shuffle; the rank
table (its size is checked) goes to the executors as a broadcast variable.

Defined results: a null or empty text has no tokens (both digests are those
of nothing); other columns are dropped; repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import uuid

from pyspark.sql import DataFrame

from strata.llm.common import map_rows, only

MAX_VOCABULARY = 1_000_000  # the broadcast's bound; vocabularies are fixed files
MEMO = 200_000  # pieces remembered by a worker process, and as many older ones


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{len(ranks)} tokens; a vocabulary has at most {MAX_VOCABULARY}")
    return ranks


def last_merges(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """The two tokens that each token of several bytes is made of last."""
    out = {}
    for token, own in ranks.items():
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            r, at = min((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
            if r >= own:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2 and all(p in ranks for p in parts):
            out[own] = ranks[parts[0]], ranks[parts[1]]
    return out


class Vocabulary:
    """Ranks by token, tokens by id, and which two tokens can be neighbours."""

    def __init__(self, ranks: dict[bytes, int], made_of: dict[int, tuple[int, int]] | None = None, memo: int = MEMO):
        self.memo = memo
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.made_of = last_merges(ranks) if made_of is None else made_of
        self.longest, self.beyond = max(map(len, ranks)), max(ranks.values()) + 1
        self.pairs: dict[tuple[int, int], bool] = {}
        #: each end of a token, with the token's id if it is one, else -1
        self.tails = {t[i:]: -1 for t in ranks for i in range(1, len(t))} | ranks

    def valid(self, a: int, b: int) -> bool:
        """Whether token b after token a (-1: after nothing) stays as it is."""
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > 4 * self.memo:
                self.pairs.clear()
            ok = self.pairs[a, b] = self._made(b) and (a < 0 or self._apart(a, b))
        return ok

    def _made(self, t: int) -> bool:
        return t in self.made_of or len(self.tokens[t]) == 1

    def _apart(self, a: int, b: int) -> bool:
        """Undo the merges that made either token, the latest first (of equal
        ones the right one is later): the parts that face each other must not
        have a merge that comes before the last one undone."""
        before = self.beyond
        while True:
            r = self.ranks.get(self.tokens[a] + self.tokens[b])
            if r is not None and r < before:
                return False
            at_a, at_b = (x if x in self.made_of else -1 for x in (a, b))
            if at_a < 0 and at_b < 0:
                return True
            if at_a > at_b:
                a, before = self.made_of[a][1], a
            else:
                b, before = self.made_of[b][0], b + 1


class Prefixes:
    """The last token of each prefix of a growing, editable byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"", last: list[int] | None = None):
        """``last``: the entries of the shortest prefixes, where they are known."""
        self.v, self.data, self.last = vocabulary, b"", [] if last is None else last
        self.append(data)

    def _enter(self, upto: int) -> None:
        """Enter the last tokens of the prefixes from the first one without, up to that long."""
        data, last, known, pairs, valid = self.data, self.last, self.v.tails, self.v.pairs, self.v.valid
        for end in range(len(last) + 1, upto + 1):
            for start in range(end - 1, -1, -1):
                t = known.get(data[start:end])
                if t is None:
                    raise ValueError(f"no token ends at byte {end}")
                if t >= 0:
                    before = last[start - 1] if start else -1
                    ok = pairs.get((before, t))
                    if valid(before, t) if ok is None else ok:
                        last.append(t)
                        break

    def append(self, more: bytes) -> None:
        self.data += more
        self._enter(len(self.data))

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace bytes start to stop; gives the number of entries computed.

        An entry depends on bytes and entries at most the longest token back,
        so once that many in a row beyond the edit are as before, all are."""
        old, beyond, shift = self.last, start + len(new), stop - start - len(new)
        self.data, self.last = self.data[:start] + new + self.data[stop:], old[:start]
        same = 0
        for end in range(start + 1, len(self.data) + 1):
            self._enter(end)
            if end > beyond:
                same = same + 1 if self.last[-1] == old[end - 1 + shift] else 0
                if same >= self.v.longest:
                    self.last += old[end + shift:]
                    return end - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.v.tokens[out[-1]])
        return out[::-1]


class Encoder:
    """Encodes and decodes whole texts; remembers up to ``memo`` short pieces and as many older ones."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, made_of: dict[int, tuple[int, int]] | None = None, memo: int = MEMO):
        import regex

        # \s of the tokenizer is Unicode's white space
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
                                   .replace(r"\S", r"\P{White_Space}")).findall
        self.v = Vocabulary(ranks, made_of, memo)
        self.memo = Memo(self.piece, memo)
        self.known: dict[bytes, int] = {}

    def encode(self, text: str) -> list[int]:
        return [i for p in self.split(text) for i in Prefixes(self.v, p.encode()).ids()]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.v.tokens.__getitem__, ids))

    def piece(self, p: str) -> tuple[int, str, bytes]:
        """How many ids, the ids as text, and their bytes decoded."""
        data = p.encode()
        whole = self.v.ranks.get(data)
        # a valid token that is the whole piece is its one last token
        ids = [whole] if whole is not None and self.v.valid(-1, whole) else self.prefixes(data).ids()
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def prefixes(self, data: bytes) -> Prefixes:
        """The entries of a piece, from the longest of its prefixes that another piece had, too."""
        known, last = self.known, []
        if len(data) > 64:
            return Prefixes(self.v, data)
        if len(known) > 4 * self.v.memo:
            known.clear()
        for end in range(1, len(data) + 1):
            t = known.get(data[:end])
            if t is None:
                break
            last.append(t)
        done = len(last)
        found = Prefixes(self.v, data, last)
        for end in range(done + 1, len(data) + 1):
            known[data[:end]] = last[end - 1]
        return found

    def digest(self, text: str) -> tuple[int, str, str]:
        n, ids, data = zip(*map(self.memo.__getitem__, self.split(text)), strict=True) if text else ((), (), ())
        return (sum(n), hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(b"".join(data)).hexdigest())


class Memo(dict):
    """Results by piece: up to ``most`` recent ones and as many older ones."""

    def __init__(self, of, most: int = MEMO):
        self.of, self.most, self.older = of, most, {}

    def __missing__(self, p: str):
        got = self.older.get(p) or self.of(p)
        if len(p) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[p] = got
        return got


def _shared(df: DataFrame, ranks: dict[bytes, int], pattern: str, memo: int = MEMO):
    """One encoder a worker process, with the pieces that it knows: this
    function's globals are sent anew with each task, ``sys`` stays."""
    sent, key = df.sparkSession.sparkContext.broadcast((ranks, last_merges(ranks))), uuid.uuid4().hex

    def encoder() -> Encoder:
        held = vars(sys).setdefault("_strata_encoder", {})
        if key not in held:
            held.clear()  # of an earlier query
            held[key] = Encoder(sent.value[0], pattern, sent.value[1], memo)
        return held[key]

    return encoder


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id and its token ids."""
    encoder = _shared(docs, ranks, pattern)
    return map_rows(only(docs, "doc_id", "text"), lambda b: {
        "doc_id": b["doc_id"], "ids": [encoder().encode(t) for t in b["text"]]}, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id and the bytes of its ids."""
    encoder = _shared(encoded, ranks, pattern)
    return map_rows(encoded.select("doc_id", "ids"), lambda b: {
        "doc_id": b["doc_id"], "data": [encoder().decode(x or []) for x in b["ids"]]}, "doc_id long, data binary")


def encode_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, memo: int = MEMO) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (a round trip by row).

    Workers keep their encoder; a smaller ``memo`` leaves more memory to the steps
    that follow in the same executors, and takes more time."""
    encoder = _shared(docs, ranks, pattern, memo)

    def run(b):
        e = encoder()
        n, ids, data = zip(*[e.digest(t) for t in b["text"]], strict=True)
        return {"doc_id": b["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": data}

    return map_rows(only(docs, "doc_id", "text"), run,
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
