"""Byte-level BPE encoding of whole columns by speculation and verification.

Per Arrow batch:

1. *Split.*  Words are cut by array passes over code-point classes that give
   the same words as the public split pattern (contractions, letters, numbers,
   other, white space).  No regular expression runs over the text.
2. *Deduplicate.*  Arrow dictionary-encodes the words; later steps see each
   distinct word of a batch once.
3. *Speculate.*  Greedy longest match proposes tokens for all words at once,
   with substring hashes looked up in one sorted table per token length.
4. *Verify.*  A token sequence is the BPE result exactly if every adjacent pair
   is: a pair is good when undoing its merges, latest first, never meets a
   merge across the seam that would have come earlier.  That test runs on
   arrays of distinct pairs.
5. *Repair.*  Only words with a bad pair are merged exactly, rank by rank.

Memory is bounded: texts are handled in slices of about ``SLICE_BYTES``; a longer text is
cut before single spaces between visible ASCII characters, where a word always
begins. Only a longer run without such a place stays whole. Caches have a fixed
size and change nothing but speed.

Null and empty texts have an empty list of ids.  Bytes that are not UTF-8 count
as U+FFFD, as when the text is decoded with replacement.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SLICE_BYTES = 4 << 20
BLOCK_BYTES = 1 << 18
LONG_WORD = 2048
MAX_VOCAB_BYTES = 64 << 20

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point, by the Unicode properties of the split pattern."""
    import regex

    table = np.zeros(0x110000, dtype=np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    index = np.array(points)
    chars = "".join(map(chr, points))
    for cls, prop in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(prop, chars):
            table[index[m.start() : m.end()]] = cls
    return table


def word_starts(cp: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Sorted positions in ``cp`` at which a word begins.

    ``doc_starts`` are the positions of first characters of non-empty texts; no word reaches over them.
    """
    n = len(cp)
    cls = char_classes()[cp]
    first = np.zeros(n + 1, dtype=bool)
    first[doc_starts] = True
    first[n] = True
    start = first[:n].copy()
    start[1:] |= cls[1:] != cls[:-1]
    # last character of each white-space run that is followed by something in the same text
    is_space = cls == SPACE
    run_end = np.flatnonzero(is_space[:-1] & ~is_space[1:] & ~first[1:n])
    start[run_end] = True
    start[run_end[cp[run_end] == 0x20] + 1] = False
    # contractions: an apostrophe that begins a word, then s t m d, or re ve ll
    ap = np.flatnonzero((cp == 0x27) & start)
    ap = ap[ap + 1 < n]
    ap = ap[~first[ap + 1]]
    if len(ap):
        one = cp[ap + 1]
        two = np.where((ap + 2 < n) & ~first[np.minimum(ap + 2, n)], cp[np.minimum(ap + 2, n - 1)], 0)
        short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        hit = short | long
        start[ap[hit] + 1] = False
        end = ap[hit] + np.where(short[hit], 2, 3)
        end = end[end < n]
        start[end[cls[end] == LETTER]] = True
    return np.flatnonzero(start)


class Encoder:
    """Encodes batches of texts with the ranks of a ``.tiktoken`` vocabulary."""

    MULT = 0x9E3779B97F4A7C15 | 1
    CACHE_BITS = 18

    def __init__(self, vocab: bytes) -> None:
        self.tokens: list[bytes] = [b""] * sum(1 for line in vocab.splitlines() if line.strip())
        for line in vocab.splitlines():
            if line.strip():
                word, rank = line.split()
                self.tokens[int(rank)] = base64.b64decode(word)
        self.rank = {t: i for i, t in enumerate(self.tokens)}
        if b"" in self.rank or len(self.rank) != len(self.tokens):
            raise ValueError("the vocabulary must give every rank from 0 on once")
        self.n_bytes = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.token_offsets = np.concatenate([[0], np.cumsum(self.n_bytes)])
        self.token_data = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.byte_token = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int32)
        self.max_len = int(self.n_bytes.max())
        self._hash_tables()
        self._merge_tables()
        size = 1 << self.CACHE_BITS
        self.pair_keys = np.full(size, -1, dtype=np.int64)
        self.pair_good = np.zeros(size, dtype=bool)

    # -- tables ---------------------------------------------------------------

    def _hash_tables(self) -> None:
        with np.errstate(over="ignore"):
            mult = np.uint64(self.MULT)
            inverse = np.uint64(pow(self.MULT, -1, 1 << 64))
            n = max(BLOCK_BYTES + LONG_WORD, len(self.token_data)) + 1
            self.power = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n - 1, mult, dtype=np.uint64))])
            self.unpower = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n - 1, inverse, dtype=np.uint64))])
        sums = self._prefix_sums(self.token_data)
        hashes = self._substring(sums, self.token_offsets[:-1], self.token_offsets[1:])
        self.by_len: list[tuple[np.ndarray, np.ndarray] | None] = [None] * (self.max_len + 1)
        for length in np.unique(self.n_bytes):
            ids = np.flatnonzero(self.n_bytes == length)
            order = np.argsort(hashes[ids])
            self.by_len[length] = (hashes[ids][order], ids[order].astype(np.int32))

    def _prefix_sums(self, data: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)])])

    def _substring(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (sums[end] - sums[start]) * self.unpower[start]

    def _find(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Token id for each hash of a substring of that length, else -1."""
        if self.by_len[length] is None:
            return np.full(len(hashes), -1, dtype=np.int32)
        keys, ids = self.by_len[length]
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, ids[at], np.int32(-1))

    def _merge_tables(self) -> None:
        """The last merge of every token, and the merge table by pair."""
        self.left = np.full(len(self.tokens), -1, dtype=np.int64)
        self.right = np.full(len(self.tokens), -1, dtype=np.int64)
        pairs: dict[tuple[int, int], int] = {}
        for i, t in enumerate(self.tokens):
            if len(t) > 1:
                parts = self._merge(t, below=i)
                if len(parts) != 2:
                    raise ValueError(f"token {i} is not the merge of two earlier tokens")
                self.left[i], self.right[i] = parts
                pairs[parts[0], parts[1]] = i
        keys = np.array([(a << 32) | b for a, b in pairs], dtype=np.int64)
        values = np.array(list(pairs.values()), dtype=np.int64)
        order = np.argsort(keys)
        self.merge_keys, self.merge_ids = keys[order], values[order]
        every = np.arange(256)
        first, second = self.byte_token[np.repeat(every, 256)], self.byte_token[np.tile(every, 256)]
        #: rank of the merge of two bytes, at 256 times the first and the second
        self.byte_pairs = self._seam_ranks(first, second)

    # -- exact merging --------------------------------------------------------

    def _merge(self, word: bytes, below: int | None = None) -> list[int]:
        """Merges by lowest rank, leftmost first, with a heap: O(n log n)."""
        n = len(word)
        rank, limit = self.rank, len(self.tokens) if below is None else below
        end = list(range(1, n + 1))
        prev = list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int]] = []
        for i in range(n - 1):
            r = rank.get(word[i : i + 2], limit)
            if r < limit:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            if not alive[i]:
                continue
            j = end[i]
            if j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                prev[stop] = i
                r = rank.get(word[i : end[stop]], limit)
                if r < limit:
                    heapq.heappush(heap, (r, i, end[stop]))
            if prev[i] >= 0:
                p = prev[i]
                r = rank.get(word[p:stop], limit)
                if r < limit:
                    heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(rank[word[i : end[i]]])
            i = end[i]
        return out

    def _seam_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or the number of tokens if there is none."""
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        return np.where(self.merge_keys[at] == key, self.merge_ids[at], len(self.tokens)).astype(np.int32)

    def merge_many(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owner (index into start) and token of the exact merges of many words, in order.

        Each round merges the lowest-ranked pair of every word at all its places, left to right. A merged
        token only takes part in merges of higher rank, so this equals merging one place at a time.
        """
        none = len(self.tokens)
        owner = np.repeat(np.arange(len(start)), end - start)
        token = self.byte_token[data[ragged(start, end - start)]]
        done_owner, done_token = [], []
        # seam[i]: rank of the merge of i and i + 1
        seam = np.full(len(token), none, dtype=np.int32)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        seam[inner] = self.byte_pairs[data_pairs(data, start, end)] if len(inner) else seam[:0]
        while len(token):
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            lowest = np.minimum.reduceat(seam, heads)
            sizes = np.diff(np.concatenate([heads, [len(token)]]))
            low = np.repeat(lowest, sizes)
            over = low == none
            if over.any():
                done_owner.append(owner[over])
                done_token.append(token[over])
                owner, token, seam, low = owner[~over], token[~over], seam[~over], low[~over]
                if not len(token):
                    break
            at = np.flatnonzero(seam == low)
            # of places side by side (equal tokens), every second one
            fresh = np.concatenate([[True], np.diff(at) != 1])
            index = np.arange(len(at))
            at = at[(index - np.maximum.accumulate(np.where(fresh, index, 0))) % 2 == 0]
            token[at] = seam[at]
            keep = np.ones(len(token), dtype=bool)
            keep[at + 1] = False
            seam[at] = seam[at + 1]
            moved = np.cumsum(keep)[at] - 1
            owner, token, seam = owner[keep], token[keep], seam[keep]
            right = moved[moved + 1 < len(token)]
            right = right[owner[right] == owner[right + 1]]
            seam[right] = self._seam_ranks(token[right], token[right + 1])
            left = moved[moved > 0] - 1
            left = left[owner[left] == owner[left + 1]]
            seam[left] = self._seam_ranks(token[left], token[left + 1])
        owner = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        token = np.concatenate(done_token) if done_token else np.zeros(0, np.int32)
        order = np.argsort(owner, kind="stable")
        return owner[order], token[order]

    # -- verification ---------------------------------------------------------

    def pairs_good(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE of the joined bytes of each pair gives just that pair."""
        keys = (a.astype(np.int64) << 32) | b.astype(np.int64)
        with np.errstate(over="ignore"):
            slot = ((keys.view(np.uint64) * np.uint64(self.MULT)) >> np.uint64(64 - self.CACHE_BITS)).astype(np.int64)
        known = self.pair_keys[slot] == keys
        good = self.pair_good[slot] & known
        todo = np.flatnonzero(~known)
        if len(todo):
            distinct, back = np.unique(keys[todo], return_inverse=True)
            verdict = self._check_pairs(distinct >> 32, distinct & 0xFFFFFFFF)
            good[todo] = verdict[back]
            self.pair_keys[slot[todo]] = keys[todo]
            self.pair_good[slot[todo]] = good[todo]
        return good

    def _check_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        good = np.ones(len(a), dtype=bool)
        open_ = np.arange(len(a))
        a, b = a.copy(), b.copy()
        # rank below which a merge over the seam would have come before what is undone so far
        limit = np.full(len(a), len(self.tokens), dtype=np.int64)
        while len(open_):
            key = (a << 32) | b
            at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
            bad = (self.merge_keys[at] == key) & (self.merge_ids[at] < limit)
            good[open_[bad]] = False
            keep = ~bad
            open_, a, b, limit = open_[keep], a[keep], b[keep], limit[keep]
            # undo the later of the two tokens' last merges; of equal ranks the right one came later
            undo_a = a > b
            whole_a, whole_b = self.left[a] < 0, self.left[b] < 0
            done = whole_a & whole_b
            undo_a = np.where(whole_a, False, np.where(whole_b, True, undo_a))
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            keep = ~done
            open_, a, b, limit = open_[keep], a[keep], b[keep], limit[keep]
        return good

    # -- words ----------------------------------------------------------------

    def _greedy_scalar(self, word: bytes) -> list[int]:
        out, i, n, rank = [], 0, len(word), self.rank
        while i < n:
            for size in range(min(self.max_len, n - i), 0, -1):
                t = rank.get(word[i : i + size])
                if t is not None:
                    out.append(t)
                    i += size
                    break
        return out

    def _greedy_block(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owner (index into start) and token of every proposed token, in order."""
        sums = self._prefix_sums(data)
        owners, tokens = [], []
        live, pos = np.arange(len(start)), start.copy()
        while len(live):
            rest = end[live] - pos
            token = np.full(len(live), -1, dtype=np.int32)
            waiting = np.arange(len(live))
            for length in range(min(self.max_len, int(rest.max())), 0, -1):
                if self.by_len[length] is None:
                    continue
                fits = rest[waiting] >= length
                try_ = waiting[fits]
                if not len(try_):
                    continue
                p = pos[try_]
                found = self._find(length, self._substring(sums, p, p + length))
                token[try_] = found
                hit = found >= 0
                if hit.any():
                    missed = np.ones(len(waiting), dtype=bool)
                    missed[np.flatnonzero(fits)[hit]] = False
                    waiting = waiting[missed]
                    if not len(waiting):
                        break
            owners.append(live)
            tokens.append(token)
            pos = pos + self.n_bytes[token]
            keep = pos < end[live]
            live, pos = live[keep], pos[keep]
        owner, token = np.concatenate(owners), np.concatenate(tokens)
        order = np.argsort(owner, kind="stable")
        return owner[order], token[order]

    def encode_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, and the offset of each word's ids."""
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        owners, tokens = [], []
        long = sizes > LONG_WORD
        for w in np.flatnonzero(long):
            ids = self._greedy_scalar(data[offsets[w] : offsets[w + 1]].tobytes())
            owners.append(np.full(len(ids), w))
            tokens.append(np.array(ids, dtype=np.int32))
        # blocks of words up to BLOCK_BYTES; long words take no room in them
        short_ids = np.flatnonzero(~long & (sizes > 0))
        room = np.cumsum(sizes[short_ids])
        cuts = np.searchsorted(room, np.arange(0, room[-1] if len(room) else 0, BLOCK_BYTES), side="left")
        for lo, hi in zip(cuts, [*cuts[1:], len(short_ids)]):
            ids = short_ids[lo:hi]
            if not len(ids):
                continue
            first, last = offsets[ids[0]], offsets[ids[-1] + 1]
            if last - first <= BLOCK_BYTES + LONG_WORD:
                piece, start = data[first:last], offsets[ids] - first
            else:
                start = np.concatenate([[0], np.cumsum(sizes[ids])[:-1]])
                piece = data[np.repeat(offsets[ids] - start, sizes[ids]) + np.arange(sizes[ids].sum())]
            owner, token = self._greedy_block(piece, start, start + sizes[ids])
            owners.append(ids[owner])
            tokens.append(token)
        if not owners:
            return np.zeros(0, dtype=np.int32), np.zeros(n + 1, dtype=np.int64)
        owner, token = np.concatenate(owners), np.concatenate(tokens)
        if long.any():
            order = np.argsort(owner, kind="stable")
            owner, token = owner[order], token[order]
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        good = self.pairs_good(token[inner], token[inner + 1])
        bad = np.unique(owner[inner[~good]])
        # a hash that hit the wrong token would show as other bytes or another length
        wrong = self._differs(data, offsets, owner, token)
        if len(wrong):
            bad = np.union1d(bad, wrong)
        if len(bad):
            keep = np.ones(n, dtype=bool)
            keep[bad] = False
            kept = keep[owner]
            owner, token = [owner[kept]], [token[kept]]
            small = bad[sizes[bad] <= LONG_WORD]
            mended, ids = self.merge_many(data, offsets[small], offsets[small + 1])
            owner.append(small[mended])
            token.append(ids)
            for w in bad[sizes[bad] > LONG_WORD]:
                ids = self._merge(data[offsets[w] : offsets[w + 1]].tobytes())
                owner.append(np.full(len(ids), w))
                token.append(np.array(ids, dtype=np.int32))
            owner, token = np.concatenate(owner), np.concatenate(token)
            order = np.argsort(owner, kind="stable")
            owner, token = owner[order], token[order]
        counts = np.bincount(owner, minlength=n)
        return token, np.concatenate([[0], np.cumsum(counts)])

    def _differs(self, data: np.ndarray, offsets: np.ndarray, owner: np.ndarray, token: np.ndarray) -> np.ndarray:
        sizes = self.n_bytes[token]
        total = np.bincount(owner, weights=sizes, minlength=len(offsets) - 1).astype(np.int64)
        wrong = np.flatnonzero(total != np.diff(offsets))
        if len(wrong):
            return wrong
        at = ragged(self.token_offsets[token], sizes)
        differs = self.token_data[at] != data[: len(at)]
        return np.unique(np.repeat(owner, sizes)[differs]) if differs.any() else wrong

    # -- texts ----------------------------------------------------------------

    def encode_slice(self, texts: pa.Array) -> Encoded:
        return Encoded(self, texts)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_slice(pa.array([text], pa.string())).ids().tolist()


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The concatenation of ranges start[i] .. start[i] + count[i]."""
    total = np.cumsum(count)
    return np.repeat(start - (total - count), count) + np.arange(total[-1] if len(total) else 0)


def data_pairs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """256 times the first and the second byte of every neighbouring pair within each range, in order."""
    at = ragged(start, np.maximum(end - start - 1, 0))
    return data[at].astype(np.int64) * 256 + data[at + 1]


class Encoded:
    """Words and tokens of a slice of texts.

    ``text_words``: offset of each text's words; ``word_bytes``: offset of each word in ``data``;
    ``word_index``: distinct word of each word; ``distinct_tokens``: the tokens of distinct words
    from ``distinct_offsets``.
    """

    def __init__(self, encoder: Encoder, texts: pa.Array) -> None:
        self.encoder = encoder
        texts = valid_utf8(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first = int(offsets[0])
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, dtype=np.uint8)[first : int(offsets[-1])] if raw is not None else np.zeros(0, np.uint8)
        self.text_bytes = offsets - first
        cp = np.frombuffer(self.data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        self.cp = cp
        width = np.ones(len(cp), dtype=np.int8)
        for least in (0x80, 0x800, 0x10000):
            width += cp >= least
        self.char_bytes = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        self.text_chars = np.searchsorted(self.char_bytes, self.text_bytes)
        filled = np.diff(self.text_chars) > 0
        self.word_chars = word_starts(cp, self.text_chars[:-1][filled]) if len(cp) else np.zeros(0, np.int64)
        self.word_bytes = np.concatenate([self.char_bytes[self.word_chars], [len(self.data)]])
        self.word_chars = np.concatenate([self.word_chars, [len(cp)]])
        self.text_words = np.searchsorted(self.word_bytes[:-1], self.text_bytes)
        words = pa.Array.from_buffers(
            pa.large_binary(), len(self.word_bytes) - 1, [None, pa.py_buffer(self.word_bytes.astype(np.int64)), pa.py_buffer(self.data)]
        ).dictionary_encode()
        self.word_index = words.indices.to_numpy()
        distinct = words.dictionary
        self.distinct_tokens, self.distinct_offsets = encoder.encode_words(
            np.frombuffer(distinct.buffers()[2], dtype=np.uint8) if len(distinct) else np.zeros(0, np.uint8),
            np.frombuffer(distinct.buffers()[1], dtype=np.int64)[: len(distinct) + 1] if len(distinct) else np.zeros(1, np.int64),
        )
        self.word_tokens = np.diff(self.distinct_offsets)[self.word_index]
        self.word_token_offsets = np.concatenate([[0], np.cumsum(self.word_tokens, dtype=np.int64)])
        self.text_tokens = self.word_token_offsets[self.text_words]

    def ids(self) -> np.ndarray:
        return self.distinct_tokens[ragged(self.distinct_offsets[:-1][self.word_index], self.word_tokens)]

    def counts(self) -> np.ndarray:
        return np.diff(self.text_tokens)


def valid_utf8(texts: pa.Array) -> pa.Array:
    """As large_string without nulls and without bytes that are not UTF-8."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    try:
        texts.cast(pa.large_string())
    except pa.ArrowInvalid:
        texts = pa.array([t.as_py().decode("utf-8", "replace").encode() for t in texts], pa.large_binary())
    return texts


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes, or of a single longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo, size = 0, 0
    for i, s in enumerate(sizes):
        if size and size + s > most:
            yield lo, i
            lo, size = i, 0
        size += int(s)
    if lo < len(sizes):
        yield lo, len(sizes)


def parts_of(text: bytes, most: int = SLICE_BYTES) -> Iterator[bytes]:
    """A text in parts of about ``most`` bytes that are encoded alike alone and together."""
    data = np.frombuffer(text, dtype=np.uint8)
    at = 0
    while len(data) - at > most:
        cut, seen = 0, at + most
        while not cut and seen < len(data):
            some = data[seen - 1 : seen + BLOCK_BYTES]
            seen_by = (some > 0x20) & (some < 0x7F)
            places = np.flatnonzero((some[1:-1] == 0x20) & seen_by[:-2] & seen_by[2:])
            if len(places):
                cut = seen + int(places[0])
            seen += BLOCK_BYTES
        if not cut:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def encoded_slices(encoder: Encoder, texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, Callable[[], np.ndarray]]]:
    """Ranges of texts with the offsets of their tokens and a function for the tokens."""
    for lo, hi in slices(texts, most):
        part = texts.slice(lo, hi - lo)
        if hi - lo == 1 and part.is_valid()[0].as_py() and len(raw := part.cast(pa.large_binary())[0].as_buffer().to_pybytes()) > most:
            ids = [encoder.encode_slice(pa.array([x], pa.large_binary())).ids() for x in parts_of(raw, most)]
            whole = np.concatenate(ids)
            yield lo, hi, np.array([0, len(whole)]), lambda whole=whole: whole
        else:
            e = encoder.encode_slice(part)
            yield lo, hi, e.text_tokens, e.ids


_encoders: dict[int, Encoder] = {}


def encoder_for(vocab: bytes) -> Encoder:
    """One encoder for each vocabulary in a Python worker."""
    key = hash(vocab)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocab)
    return _encoders[key]


def read_vocab(path: str = DEFAULT_VOCAB) -> bytes:
    """The vocabulary file, read on the driver; its size is checked because it is broadcast."""
    with open(path, "rb") as f:
        vocab = f.read(MAX_VOCAB_BYTES + 1)
    if len(vocab) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCAB_BYTES} bytes")
    return vocab


def encode_column(df: DataFrame, key: str, text: str | Column = "text", vocab_path: str = DEFAULT_VOCAB) -> DataFrame:
    """``key`` and ``ids``, the token ids of ``text``, for every row of ``df``.

    A null or empty text has an empty list. Other columns of ``df`` are not read; repeated rows stay repeated.
    No shuffle: one pass over the scan.
    """
    vocab = df.sparkSession.sparkContext.broadcast(read_vocab(vocab_path))
    source = df.select(F.col(key).alias("key"), (F.col(text) if isinstance(text, str) else text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocab.value)
        for batch in batches:
            texts = batch.column(1)
            for lo, hi, offsets, tokens in encoded_slices(encoder, texts):
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids], names=["key", "ids"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def count_column(df: DataFrame, key: str, text: str | Column = "text", vocab_path: str = DEFAULT_VOCAB) -> DataFrame:
    """``key`` and ``n_tokens`` of every row; 0 for null and empty texts."""
    vocab = df.sparkSession.sparkContext.broadcast(read_vocab(vocab_path))
    source = df.select(F.col(key).alias("key"), (F.col(text) if isinstance(text, str) else text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocab.value)
        for batch in batches:
            texts = batch.column(1)
            for lo, hi, offsets, _ in encoded_slices(encoder, texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets), pa.int64())], names=["key", "n_tokens"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_tokens bigint").select(F.col("key").alias(key), "n_tokens")
