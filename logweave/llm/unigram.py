"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary matches that end at each place of a word; dynamic programming carries
the best score and its number of pieces, nothing else. The ties are those of the unigram tokenizer in the installed
`tokenizers` library: candidates for a place come from the earliest start on, a later one wins only if its sum is strictly
greater; a character without any match is an unknown, at the least score minus 10; neighbouring unknowns are one token
(or, with byte fallback, each unknown is as many tokens as it has bytes). Sums are float64, added from the left.

Spaces become the mark U+2581, with one before the text. A piece with the mark past its first place that is not marks
alone would cross words; with none in the vocabulary, words are scored one by one, each distinct one once in a task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from logweave.llm.common import slices, texts

MARK = "▁"
#: What the installed tokenizer takes off the least score for an unknown character.
UNKNOWN_PENALTY = 10.0
REMEMBERED = 150_000


def vocabulary(model_file: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with log-probabilities, without control, unknown and byte pieces; and the id of the unknown piece.

    A unigram model's own scores are taken as they are. A merge model has whole numbers that only order its pieces; these get
    the log-probabilities of Zipf's law, in which the piece of rank r has a share in proportion to 1 / r. Nothing is trained.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces, scores = [model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids]
    if all(x == int(x) for x in scores):
        whole = math.fsum(1 / r for r in range(1, len(ids) + 1))
        rank = {k: r for r, k in enumerate(sorted(range(len(ids)), key=lambda k: -scores[k]), 1)}
        scores = [-math.log(rank[k] * whole) for k in range(len(ids))]
    return list(zip(pieces, scores, strict=True)), model.unk_id()


class Counter:
    """Number of tokens of a text."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        best: dict[str, float] = {}
        for piece, score in pieces:
            best.setdefault(piece, float(score))
        for piece, score in best.items():
            self.automaton.add_word(piece, (len(piece), score))
            if len(piece) == 1:
                self.single.add(piece)
        self.automaton.make_automaton()
        self.unknown = min(best.values(), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        crossing = any(MARK in p[1:] and p.strip(MARK) for p in best)
        self.split = None if crossing else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.seen: dict[str, int] = {}

    def viterbi(self, word: str) -> int:
        """Pieces of the best segmentation of one word."""
        n = len(word)
        score: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        fused = [False] * (n + 1)  # the best segmentation up to here ends with an unknown
        score[0] = 0.0
        by_end: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, hit in self.automaton.iter(word):
            by_end[end].append(hit)
        for end in range(n):
            hits = by_end[end]
            if len(hits) > 1:
                hits.sort(reverse=True)
            best, pieces = None, 0
            for length, s in hits:
                start = end + 1 - length
                total = score[start] + s
                if best is None or total > best:
                    best, pieces = total, count[start] + 1
            if not hits or hits[-1][0] != 1:
                total = score[end] + self.unknown
                if best is None or total > best:
                    best, fused[end + 1] = total, True
                    if self.byte_fallback:
                        pieces = count[end] + len(word[end].encode("utf-8", "surrogatepass"))
                    else:
                        pieces = count[end] + (not fused[end])
            score[end + 1], count[end + 1] = best, pieces
        return count[n]

    def known(self, word: str) -> int:
        """The same for a word whose characters are all pieces: no place lacks a match, so no unknown can win.

        The automaton gives the matches of one end from the longest on, that is from the earliest start on.
        """
        score, count, last = [0.0], [0], -1
        for end, (length, s) in self.automaton.iter(word):
            start = end + 1 - length
            total = score[start] + s
            if end != last:
                score.append(total)
                count.append(count[start] + 1)
                last = end
            elif total > score[-1]:
                score[-1] = total
                count[-1] = count[start] + 1
        return count[-1]

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        words = [marked] if self.split is None else self.split.findall(marked)
        seen = self.seen
        try:
            return sum([seen[w] for w in words])
        except KeyError:
            pass
        if len(seen) > REMEMBERED:
            seen.clear()
        for w in set(words):
            if w not in seen:
                seen[w] = self.known(w) if self.single.issuperset(w) else self.viterbi(w)
        return sum([seen[w] for w in words])


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], byte_fallback: bool = True) -> DataFrame:
    """(doc_id, n_tokens) of every document; a null or empty text has none, repeated rows are counted one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for whole in batches:
            count = count or Counter(pieces, byte_fallback)
            for batch in slices(whole):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t) for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long")
