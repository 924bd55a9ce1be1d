"""Token ids of whole texts with a public tokenizer, word by word.

The tokenizers this is for never join what white space separates, so a text's ids are the ids of its words in order.
Each different word is encoded once and its ids are copied to where it stands.
"""

from __future__ import annotations

import os
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from verisheaf.llm.common import row_hashes, text_buffer

#: Words whose ids a worker remembers unless told otherwise (about 70 bytes each); beyond, it forgets those that the
#: fewest calls had.
REMEMBERED = 300_000
#: Words that are encoded as one text.
TOGETHER = 500


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder_for(path: str, plain_specials: bool = False, remembered: int = REMEMBERED) -> WordEncoder:
    """An encoder that a worker process keeps from task to task with the words it knows."""
    kept = sys.__dict__.setdefault("_verisheaf_encoders", {})
    key = (path, plain_specials, remembered)
    if key not in kept:
        kept[key] = WordEncoder(*key)
    return kept[key]


class _Words:
    """Different words, found by hashes in an open table; what is found is compared with the word itself."""

    def __init__(self):
        self.words = pa.array([], pa.large_string())
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.table = np.full(1 << 16, -1, dtype=np.int32)

    def __len__(self) -> int:
        return len(self.words)

    @staticmethod
    def _hashes(words: pa.Array) -> np.ndarray:
        raw, offsets = text_buffer(words)
        return row_hashes(raw, offsets)

    def find(self, words: pa.Array) -> np.ndarray:
        """Places of words; -1: not here."""
        hashes = self._hashes(words)
        slot = (hashes & np.uint64(len(self.table) - 1)).astype(np.int64)
        out = np.full(len(words), -1, dtype=np.int64)
        left = np.arange(len(words))
        while len(left):
            place = self.table[slot]
            left, slot, place = left[place >= 0], slot[place >= 0], place[place >= 0]
            same = self.hashes[place] == hashes[left]
            at = np.flatnonzero(same)
            same[at] = np.asarray(pc.equal(self.words.take(pa.array(place[at])), words.take(pa.array(left[at]))))
            out[left[same]] = place[same]
            left, slot = left[~same], slot[~same] + 1 & len(self.table) - 1
        return out

    def add(self, words: pa.Array) -> None:
        """Words that differ and are not here."""
        first, hashes = len(self.words), self._hashes(words)
        self.words = pa.concat_arrays([self.words, words])
        self.hashes = np.concatenate([self.hashes, hashes])
        if 2 * len(self.words) > len(self.table):
            self.table = np.full(1 << (4 * len(self.words) - 1).bit_length(), -1, dtype=np.int32)
            first, hashes = 0, self.hashes
        place = np.arange(first, len(self.words), dtype=np.int32)
        slot = (hashes & np.uint64(len(self.table) - 1)).astype(np.int64)
        while len(place):
            free = self.table[slot] < 0
            self.table[slot[free]] = place[free]
            left = self.table[slot] != place  # taken before, or by another of these
            place, slot = place[left], slot[left] + 1 & len(self.table) - 1


class WordEncoder:
    """Encodes string columns. plain_specials: the strings of special tokens are ordinary text."""

    def __init__(self, path: str, plain_specials: bool = False, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if plain_specials:
            self.tokenizer.encode_special_tokens = True
        self._pending: list = []
        self._look()
        self._forget()

    def _look(self) -> None:
        """Whether ids show where words end, and whether signs after letters are apart from them, on trial."""
        vocabulary = self.tokenizer.get_vocab()
        ending = {i for t, i in vocabulary.items() if t.endswith("</w>")}
        self.ends_word = None
        if ending:
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends_word[list(ending)] = True
        encode = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        trials = (("word", "."), ("word", ",\""), ("Über", "!!"), ("naïve", "###"), ("a", "'"), ("слово", "…"))
        self.splits_signs = all(encode(a + b) == encode(a) + encode(b) for a, b in trials)

    def _forget(self) -> None:
        self.known = _Words()
        self.uses = np.zeros(0, dtype=np.int32)
        self.ends = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _forget_rare(self) -> None:
        """Keeps words that at least two calls had, those with most uses, and no more than half."""
        kept = np.argsort(-self.uses, kind="stable")[: self.remembered // 2]
        kept = np.sort(kept[self.uses[kept] > 1])
        words, uses = self.known.words.take(pa.array(kept)), self.uses[kept] >> 1
        lengths, ids = self.ends[kept + 1] - self.ends[kept], self._ids_at(kept)
        self._forget()
        self._add(words, lengths, ids)
        self.uses = uses

    def _ids_at(self, places: np.ndarray) -> np.ndarray:
        lengths = self.ends[places + 1] - self.ends[places]
        before = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[np.repeat(self.ends[places] - before[:-1], lengths) + np.arange(before[-1])]

    def _add(self, words: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        self.known.add(words)
        self.uses = np.concatenate([self.uses, np.zeros(len(words), dtype=np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of each text, and all ids."""
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        found, lengths = [], []
        for e in encode(texts, add_special_tokens=False):
            ids = e.ids
            found.extend(ids)
            lengths.append(len(ids))
        return np.array(lengths, dtype=np.int64), np.array(found, dtype=np.int64)

    def _learn_one_by_one(self, words: pa.Array) -> None:
        listed = words.to_pylist()
        for at in range(0, len(listed), 20_000):
            self._add(words.slice(at, 20_000), *self._ids(listed[at : at + 20_000]))

    def _learn_letters(self, words: pa.Array) -> None:
        """Words of letters alone, many as one text: each ends where an id ends a word. Where the numbers don't agree,
        as with letters that change when they become lower case, one by one."""
        if self.ends_word is None:
            return self._learn_one_by_one(words)
        listed = words.to_pylist()
        chunks = [listed[at : at + TOGETHER] for at in range(0, len(listed), TOGETHER)]
        lengths, ids = self._ids([" ".join(c) for c in chunks])
        at = 0
        for k, chunk in enumerate(chunks):
            mine = ids[at : at + lengths[k]]
            at += lengths[k]
            last = np.flatnonzero(self.ends_word[mine]) + 1
            words_here = words.slice(k * TOGETHER, len(chunk))
            if len(last) == len(chunk) and last[-1] == len(mine):
                self._pending.append((words_here, np.diff(last, prepend=0), mine))
            else:
                self._learn_one_by_one(words_here)
        if self._pending:
            parts = list(zip(*self._pending, strict=True))
            self._pending = []
            self._add(pa.concat_arrays(parts[0]), np.concatenate(parts[1]), np.concatenate(parts[2]))

    def _unknown(self, words: pa.Array) -> pa.Array:
        words = words.unique()
        return words.filter(pa.array(self.known.find(words) < 0))

    def _learn(self, words: pa.Array) -> None:
        """Words of letters, of letters with other signs after them, and the rest. The second kind is put together from
        its two parts, which the tokenizers this is for split in any case."""
        plain = pc.match_substring_regex(words, r"^\p{L}+$")
        tailed = pa.array(np.zeros(len(words), dtype=bool))
        if self.splits_signs:  # ASCII signs, and no letter that becomes a letter and a mark in lower case
            tailed = pc.and_(pc.match_substring_regex(words, r"^\p{L}+[!-/:-@\[-`{-~]+$"), pc.invert(pc.match_substring(words, "İ")))
        both = words.filter(tailed)
        stems, tails = pc.replace_substring_regex(both, r"[^\p{L}]+$", ""), pc.replace_substring_regex(both, r"^\p{L}+", "")
        self._learn_letters(self._unknown(pa.concat_arrays([words.filter(plain), stems])))
        self._learn_one_by_one(self._unknown(pa.concat_arrays([words.filter(pc.invert(pc.or_(plain, tailed))), tails])))
        places = np.stack([self.known.find(x) for x in (stems, tails)], axis=1)
        lengths = (self.ends[places + 1] - self.ends[places]).sum(axis=1)
        self._add(both, lengths, self._ids_at(places.reshape(-1)))

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each row's followed by end_id, and the number of ids before each row. Nulls are empty."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string()).fill_null("")
        lists = pc.ascii_split_whitespace(column)
        words = lists.flatten().dictionary_encode()
        rows = len(column)
        cuts = np.asarray(lists.offsets)
        cuts = cuts - cuts[0]
        different = words.dictionary.cast(pa.large_string())
        number = self.known.find(different)
        if (number < 0).any():
            if len(self.known) + np.count_nonzero(number < 0) > self.remembered:
                self._forget_rare()
                number = self.known.find(different)
            missing = number < 0
            new = different.filter(pa.array(missing))
            self._learn(new)
            number[missing] = self.known.find(new)
        self.uses[number] += 1
        # From here on the different words of this call alone, after the end.
        source = np.concatenate([np.array([end_id], dtype=np.uint32), self._ids_at(number)])
        each = self.ends[number + 1] - self.ends[number]
        codes = np.asarray(words.indices)
        lengths, starts = (np.insert(x[codes], cuts[1:], end) for x, end in ((each, 1), (1 + np.cumsum(each) - each, 0)))
        before = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(starts - before[:-1], lengths)
        at += np.arange(before[-1])
        return source[at], before[np.concatenate([[0], cuts[1:] + np.arange(1, rows + 1)])]
