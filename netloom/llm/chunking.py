"""Cutting long texts into overlapping pieces by content-defined landmarks.

A rolling hash over the eight words before a place marks it; among the places a piece may end at, the one of least hash is the
landmark. The cut goes to the nearest boundary of the best kind there is in that range: a blank line, a line end, a sentence
end, white space, any other word edge of the tokenizer, and only inside a word longer than the range a token edge. Places and
hashes depend on the text around them alone, so an edit changes the pieces it touches and the cuts then fall back into step.

Pieces are substrings. Their size is the exact number of tokens the tokenizer gives for the piece alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.bpe import DEFAULT_VOCAB, SPACE, Encoded, char_classes, encoder_for, ragged, read_vocab, slices

WINDOW = 8
#: Kinds of boundary, from none to the best.
KINDS = ["token", "edge", "word", "sentence", "line", "paragraph", "end"]
TOKEN, EDGE, WORD, SENTENCE, LINE, PARAGRAPH, END = range(7)
STOPS = np.array([ord(c) for c in ".!?…。！？"])
WIDE_STOPS = np.array([ord(c) for c in "。！？"])


class Places:
    """Kind, landmark hash and token count of the place before every word of a slice."""

    def __init__(self, e: Encoded) -> None:
        self.e = e
        cp, at = e.cp, e.word_chars[:-1]
        n = len(at)
        doc_word = np.repeat(e.text_words[:-1], np.diff(e.text_words))
        doc_char = np.repeat(e.text_chars[:-1], np.diff(e.text_words))
        space = char_classes()[cp] == SPACE
        solid = np.maximum.accumulate(np.where(space, -1, np.arange(len(cp))))
        lines = np.concatenate([[0], np.cumsum(cp == 0x0A)])
        before = np.maximum(at - 1, 0)
        last = np.maximum(solid[before], doc_char - 1)
        gap = lines[at] - lines[last + 1]
        blank = space[at] & (np.diff(e.word_chars) == 1) | space[at] & space[np.minimum(at + 1, len(cp) - 1)]
        stop = np.isin(cp[np.maximum(last, 0)], STOPS) & (last >= doc_char)
        wide = np.isin(cp[np.maximum(last, 0)], WIDE_STOPS)
        parted = space[at] | space[before]
        self.kind = np.select(
            [blank, gap >= 2, gap == 1, stop & (parted | wide), parted], [EDGE, PARAGRAPH, LINE, SENTENCE, WORD], default=EDGE
        )
        # a hash of the tokens of each distinct word, then over the words before each place
        with np.errstate(over="ignore"):
            counts = np.diff(e.distinct_offsets)
            within = ragged(np.zeros(len(counts), dtype=np.int64), counts).astype(np.uint64)
            mixed = (e.distinct_tokens.astype(np.uint64) + np.uint64(1)) * (within * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x9E3779B97F4A7C15))
            word = np.add.reduceat(mixed, e.distinct_offsets[:-1]) if len(counts) else np.zeros(0, np.uint64)
            word = (word ^ (word >> np.uint64(32)))[e.word_index]
            rolled = np.zeros(n, dtype=np.uint64)
            index = np.arange(n)
            for d in range(1, WINDOW + 1):
                rolled = rolled * np.uint64(0xC2B2AE3D27D4EB4F)
                seen = index - d >= doc_word
                rolled[seen] += word[index[seen] - d]
            rolled ^= rolled >> np.uint64(29)
            self.hash = (rolled * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(11)
        # a white-space run that is cut in two before solid text is one word where the text ends after it
        self.extra = np.zeros(n + 1, dtype=np.int64)
        width = np.diff(e.word_chars)
        tail = np.flatnonzero((width == 1) & space[at] & (index - 1 >= doc_word) & space[before]) if n else np.zeros(0, np.int64)
        tail = tail[space[at[tail - 1]]] if len(tail) else tail
        if len(tail):
            runs = [e.data[e.word_bytes[i - 1] : e.word_bytes[i + 1]].tobytes() for i in tail]
            distinct = sorted(set(runs))
            flat = np.frombuffer(b"".join(distinct), dtype=np.uint8)
            _, offsets = e.encoder.encode_words(flat, np.concatenate([[0], np.cumsum([len(r) for r in distinct])]))
            size = dict(zip(distinct, np.diff(offsets).tolist()))
            self.extra[tail + 1] = [size[r] for r in runs] - e.word_tokens[tail - 1] - e.word_tokens[tail]


def _token_cuts(e: Encoded, word: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in tokens and bytes of the places inside a word where it may be cut: between characters.

    Not before an apostrophe that ends the word: with the letters after it, it could begin a contraction.
    """
    d = e.word_index[word]
    tokens = e.distinct_tokens[e.distinct_offsets[d] : e.distinct_offsets[d + 1]]
    ends = np.cumsum(e.encoder.n_bytes[tokens])[:-1]
    byte = e.data[e.word_bytes[word] + ends]
    size = e.word_bytes[word + 1] - e.word_bytes[word]
    good = ((byte & 0xC0) != 0x80) & ~((byte == 0x27) & (ends == size - 1))
    return np.flatnonzero(good) + 1, ends[good]


def cut(places: Places, doc: int, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Start and end byte, tokens and kind of end of the pieces of a text.

    A piece ends between half the limit and the limit after its start, where there is any word edge; the next one starts at the
    last white space or word edge at least ``overlap`` tokens before that end, or at a token where that is twice as far.
    """
    e = places.e
    lo, hi = int(e.text_words[doc]), int(e.text_words[doc + 1])
    t = e.word_token_offsets[lo : hi + 1]
    ends = t + places.extra[lo : hi + 1]
    kind, hashes = places.kind[lo:hi], places.hash[lo:hi]
    byte = e.word_bytes[lo : hi + 1]
    total, at_token, at_byte, first = int(t[-1]), int(t[0]), int(byte[0]), 0
    pieces = []
    while True:
        if total - at_token <= limit:
            pieces.append((at_byte, int(byte[-1]), total - at_token, END))
            return pieces
        top = int(np.searchsorted(t, at_token + limit, side="right"))
        place = -1
        for least in (limit // 2, 2 * overlap):
            bottom = int(np.searchsorted(t, at_token + least, side="right"))
            bottom = max(bottom, first + 2)
            if bottom >= top:
                continue
            fits = np.flatnonzero(ends[bottom:top] - at_token <= limit) + bottom
            if not len(fits):
                continue
            best = kind[fits].max()
            landmark = t[fits[np.argmin(hashes[fits])]]
            good = fits[kind[fits] == best]
            place = int(good[np.argmin(np.abs(t[good] - landmark))])
            break
        if place >= 0:
            end_token, end_byte, why = int(t[place]), int(byte[place]), int(kind[place])
            pieces.append((at_byte, end_byte, int(ends[place]) - at_token, why))
            # what the shared text has by itself counts
            end_token = min(end_token, int(ends[place]))
        else:
            end_token, end_byte = _inside(e, lo, t, byte, at_token + limit, at_token)
            if end_byte <= at_byte:
                raise ValueError(f"no place to cut a text within {limit} tokens")
            pieces.append((at_byte, end_byte, end_token - at_token, TOKEN))
        back = int(np.searchsorted(t, end_token - overlap, side="right")) - 1
        parted = back
        while parted > 0 and kind[parted] < WORD and t[parted] > end_token - 2 * overlap:
            parted -= 1
        if kind[parted] >= WORD and t[parted] >= end_token - 2 * overlap:
            back = parted
        if t[back] >= end_token - 2 * overlap and t[back] > at_token:
            at_token, at_byte, first = int(t[back]), int(byte[back]), back
        else:
            then_token, then_byte = _inside(e, lo, t, byte, end_token - overlap, at_token)
            if then_byte <= at_byte:
                then_token, then_byte = end_token, end_byte
            at_token, at_byte = then_token, then_byte
            first = int(np.searchsorted(t, at_token, side="right")) - 1


def _inside(e: Encoded, lo: int, t: np.ndarray, byte: np.ndarray, most: int, above: int) -> tuple[int, int]:
    """The last token edge at or before token ``most`` and after ``above``: a word edge or a place within a word."""
    word = int(np.searchsorted(t, most, side="right")) - 1
    while word >= 0 and t[word + 1] > above:
        if t[word] < most:
            cuts, offsets = _token_cuts(e, lo + word)
            ok = np.flatnonzero(t[word] + cuts <= most)
            if len(ok) and t[word] + cuts[ok[-1]] > above:
                return int(t[word] + cuts[ok[-1]]), int(byte[word] + offsets[ok[-1]])
        if t[word] > above and t[word] <= most:
            return int(t[word]), int(byte[word])
        word -= 1
    return above, -1


def pieces(
    df: DataFrame, limit: int, overlap: int, key: str = "doc_id", text: str = "text", vocab_path: str = DEFAULT_VOCAB, whole: bool = False, with_text: bool = True
) -> DataFrame:
    """``key``, ``piece``, ``n_pieces``, ``start`` and ``end`` (characters), ``n_tokens``, ``boundary`` and ``text`` of the pieces of texts over ``limit`` tokens.

    With ``whole``, texts within the limit come out as one piece too. Null and empty texts have no piece. ``boundary`` is what
    the piece ends at. Pieces follow each other without gaps; consecutive ones share at least ``overlap`` tokens, and less than
    twice as many. Repeated rows are cut alike. Bytes that are not UTF-8 become U+FFFD.
    """
    if limit < 8 or not 0 <= overlap * 4 <= limit:
        raise ValueError("the limit must be at least 8 tokens, and 4 times the overlap")
    vocab = df.sparkSession.sparkContext.broadcast(read_vocab(vocab_path))
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).filter("text <> ''")
    if not whole:
        # a token has at least one byte
        source = source.filter(F.octet_length("text") > limit)
    names = ["key", "piece", "n_pieces", "start", "end", "n_tokens", "boundary"] + ["text"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocab.value)
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in slices(texts):
                e = encoder.encode_slice(texts.slice(lo, hi - lo))
                counts = e.counts()
                over = np.flatnonzero(counts > limit)
                places = Places(e) if len(over) else None
                rows: list[tuple] = []
                for i in range(hi - lo) if whole else over:
                    if counts[i] > limit:
                        cuts = cut(places, int(i), limit, overlap)
                    else:
                        cuts = [(int(e.text_bytes[i]), int(e.text_bytes[i + 1]), int(counts[i]), END)]
                    rows += [(lo + i, j, len(cuts), *c) for j, c in enumerate(cuts)]
                if not rows:
                    continue
                row, piece, n, start, end, tokens, kind = (np.array(c, dtype=np.int64) for c in zip(*rows))
                shift = e.text_chars[row - lo]
                out = [
                    batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(n.astype(np.int32)),
                    pa.array(np.searchsorted(e.char_bytes, start) - shift), pa.array(np.searchsorted(e.char_bytes, end) - shift),
                    pa.array(tokens.astype(np.int32)), pa.array([KINDS[k] for k in kind], pa.string()),
                ]
                if with_text:
                    out.append(pa.array([e.data[a:b].tobytes() for a, b in zip(start, end)], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    kind = source.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece int, n_pieces int, start bigint, end bigint, n_tokens int, boundary string" + ", text string" * with_text
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)
