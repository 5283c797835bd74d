"""Subword ids of whole texts by a public BPE tokenizer, one vocabulary lookup for each distinct word of a task."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Distinct words that one generation of a task's memory holds, none of them longer than LONGEST letters (so some tens of
#: MB). A full generation becomes the old one, from which words in use are taken over; longer words are encoded each time.
REMEMBERED, LONGEST = 120_000, 64


#: Latin-1 letters with punctuation after them. The tokenizer cuts between the two and lower-cases the letters, which in
#: this range are already composed, so a word's ids are those of its lower-case letters and then those of its punctuation.
LETTERS_AND_MARKS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]*)")
#: The characters that stand for the bytes of such letters in the vocabulary: printable ones for themselves, the others
#: numbered from 256 on.
BYTE_CHARS = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
BYTE_CHARS |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in BYTE_CHARS)}


class WordEncoder:
    """ids of a text, equal to Tokenizer.encode(text, add_special_tokens=False).ids, special strings in it included.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids in order. Words are
    cut at spaces and line ends alone; rarer white space stays inside a word and is the tokenizer's own business.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.model = self.plain.model
        self.seen: dict[str, bytes] = {}
        self.seen_before: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}
        self.parts_before: dict[str, bytes] = {}

    def part(self, p: str) -> bytes:
        """Ids of lower-case letters or of punctuation, straight from the merge table."""
        found = self.parts.get(p)
        if found is None:
            found = self.parts_before.get(p)
            if found is None:
                spelled = p if p.isascii() else "".join([BYTE_CHARS[b] for b in p.encode()])
                found = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
            if len(self.parts) > REMEMBERED:
                self.parts_before, self.parts = self.parts, {"": b""}
            if len(p) <= LONGEST:
                self.parts[p] = found
        return found

    def encode_word(self, w: str) -> bytes:
        if m := LETTERS_AND_MARKS.fullmatch(w):
            return self.part(m[1].lower()) + self.part(m[2])
        return array("I", self.plain.encode(w, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        words = text.replace("\n", " ").split(" ")
        try:
            return b"".join([self.seen[w] for w in words])
        except KeyError:
            pass
        if len(self.seen) > REMEMBERED:
            self.seen_before, self.seen = self.seen, {}
        seen, before = self.seen, self.seen_before
        out = []
        for w in words:
            found = seen.get(w)
            if found is None:
                found = before.get(w)
                if found is None:
                    found = self.encode_word(w)
                if len(w) <= LONGEST:
                    seen[w] = found
            out.append(found)
        return b"".join(out)


class PartNumbers(dict):
    """A number for each part of a word, in the order in which they come."""

    def __missing__(self, part: str) -> int:
        n = self[part] = len(self)
        return n


class WordsEncoder(WordEncoder):
    """WordEncoder for many words at a time: parts that were not met before are tokenized together."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(path)
        # letters and punctuation go straight to the merge table; every part's last id, and no other, ends a word there
        self.bare = Tokenizer(self.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ending = np.array([(self.bare.id_to_token(k) or "").endswith("</w>") for k in range(self.plain.get_vocab_size())])
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.start_anew()

    def start_anew(self) -> None:
        self.numbers = PartNumbers({"": 0})
        self.flat, self.begin = np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and how many each one has."""
        if len(self.numbers) > 2 * REMEMBERED:
            self.start_anew()
        known, parts, fits = len(self.numbers), [], LETTERS_AND_MARKS.fullmatch
        for w in words:
            if m := fits(w):
                parts += (m[1].lower(), m[2])
            else:
                parts += (" " + w, "")  # not in parts: all of it is the tokenizer's business
        number = np.fromiter(map(self.numbers.__getitem__, parts), np.int64, len(parts))
        new = list(self.numbers)[known:] if len(self.numbers) > known else []
        if new:
            self.learn(new)
        size = np.diff(self.begin)[number]
        after = np.cumsum(size)
        ids = self.flat[np.repeat(self.begin[number] - after + size, size) + np.arange(after[-1] if len(after) else 0)]
        if new and max(map(len, new)) > LONGEST**2:
            self.start_anew()
        return ids, size.reshape(-1, 2).sum(axis=1)

    def learn(self, new: list[str]) -> None:
        spelled = [p if p.isascii() else "".join([BYTE_CHARS[b] for b in p.encode()]) for p in new if p[0] != " "]
        ids = np.array(self.bare.encode_batch_fast([" ".join(spelled)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ending[ids]) + 1
        if len(ends) != len(spelled):
            raise ValueError("the tokenizer's merge table does not mark the ends of words")
        size = np.diff(ends, prepend=0)
        odd = [k for k, p in enumerate(new) if p[0] == " "]
        if odd:
            whole = [np.array(self.plain.encode(new[k][1:], add_special_tokens=False).ids, np.uint32) for k in odd]
            before = np.array(odd) - np.arange(len(odd))  # how many of the others stand before each
            ids = np.insert(ids, np.repeat(np.concatenate([[0], ends])[before], [len(w) for w in whole]), np.concatenate(whole))
            size = np.insert(size, before, [len(w) for w in whole])
        self.flat = np.concatenate([self.flat, ids])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(size)])
