"""Whole texts to token ids with a published tokenizer, one distinct word at a time.

Both tokenizers cut a text at white space before merging, so a word's ids don't depend on its neighbours, and a worker
keeps the ids of words it has met lately (two tables of bounded size). The texts of a slice are cut where white space
begins, and where punctuation follows a letter up to the next white space; their distinct pieces are looked up, and the
ids are gathered for all texts at once. New words of plain letters are encoded many in one text, whose ids are cut where
a word begins or ends. A text with white space where all this doesn't hold is one piece of its own and encoded whole.
"""

from __future__ import annotations

import gc
import os
from itertools import compress

import numpy as np
import pyarrow as pa

from ._text import LOWER

#: Pieces in each of a worker's two tables; one takes about 220 bytes.
KEPT_WORDS = 350_000
#: Bytes of text handled at once; a single longer text is still taken whole.
SLICE_BYTES = 4 << 20
#: Longer pieces (whole texts) are not kept.
LONGEST_KEPT = 200
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MARK_BYTES = np.zeros(256, bool)
_MARK_BYTES[list(_MARKS.encode())] = True
_LETTER_BYTES = np.zeros(256, bool)
_LETTER_BYTES[[*range(65, 91), *range(97, 123)]] = True
#: Second bytes, after 0xC3, of Latin letters (À to ÿ but × and ÷).
_LATIN_BYTES = np.zeros(256, bool)
_LATIN_BYTES[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True
_ODD_BYTES = np.zeros(256, bool)
_ODD_BYTES[[9, 11, 12, 13, 28, 29, 30, 31]] = True
_WHITE_BYTES = np.zeros(256, bool)
_WHITE_BYTES[[9, 10, 11, 12, 13, 32]] = True
#: First bytes of the white space beyond ASCII (by any of the libraries' definitions), and the characters.
_ODD_LEADS = np.zeros(256, bool)
_ODD_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_ODD_WIDE = "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_open: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _open:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _open[path] = WordEncoder(path)
    return _open[path]


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        # a byte-level tokenizer without a normalizer keeps white space: the blank belongs to the word after it
        first = self.tokenizer.encode("a\nb", add_special_tokens=False).ids
        self.keeps_space = len(first) == 3
        self.line_feed = first[1]
        self.folds = self.tokenizer.encode("A", add_special_tokens=False).ids == self.tokenizer.encode("a", add_special_tokens=False).ids
        # tokens that begin a word after a blank, or else that end a word
        self.edge = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        blank = self.tokenizer.id_to_token(self.tokenizer.encode(" a", add_special_tokens=False).ids[0])[0]
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.edge[i] = token.startswith(blank) if self.keeps_space else token.endswith("</w>")

    def encode(self, buf: np.ndarray, off: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (u4) of all texts of a slice, given as flat() gives it, end to end, and len + 1 offsets into them; with
        ``end_id``, each text's ids end with it."""
        if self.folds:
            buf = LOWER[buf]
        cuts, first = self._pieces(buf, off)
        pieces = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf)))
        coded = pieces.dictionary_encode()
        distinct, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        collects = gc.isenabled()
        gc.disable()  # nothing here is part of a cycle, and the tables are large
        try:
            ids = self._ids(distinct)
        finally:
            if collects:
                gc.enable()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat_ids = np.frombuffer(b"".join(ids), "<u4")
        starts = np.cumsum(sizes) - sizes
        size = sizes[at]
        if end_id is not None:  # a piece more after each text's last
            after = np.append(first[1:], len(at))
            size, source = np.insert(size, after, 1), np.insert(starts[at], after, len(flat_ids))
            flat_ids = np.append(flat_ids, np.uint32(end_id))
            first = first + np.arange(len(first))
        else:
            source = starts[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if total < 1 << 31 and len(flat_ids) < 1 << 31 else np.int64
        place = np.repeat((source - ends + size).astype(kind), size)
        place += np.arange(total, dtype=kind)
        return flat_ids[place].astype("<u4", copy=False), np.append(ends[first] - size[first], total) if len(first) else np.zeros(1, np.int64)

    def _pieces(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the pieces, each with the white space before it, and each text's first piece. Every text has one
        piece at least, an empty one if need be."""
        n = len(off) - 1
        if len(buf) == 0:
            return np.zeros(n + 1, np.int64), np.arange(n)
        white = (buf == 32) | (buf == 10) if self.keeps_space else _WHITE_BYTES[buf]
        text_start = np.zeros(len(buf) + 1, bool)
        text_start[off] = True
        odd = _ODD_BYTES[buf] if self.keeps_space else (buf >= 28) & (buf <= 31)
        begins = white.copy()
        begins[1:] &= ~white[:-1] | text_start[1:-1]
        if self.keeps_space:  # white space must be single, and neither first nor last
            odd |= white & (~begins | text_start[:-1] | text_start[1:])
        whole = np.zeros(n, bool)
        where = np.flatnonzero(odd)
        whole[np.searchsorted(off, where, side="right") - 1] = True
        lead = np.flatnonzero(_ODD_LEADS[buf])
        if len(lead):
            for row in np.unique(np.searchsorted(off, lead, side="right") - 1).tolist():
                if not whole[row]:
                    text = buf[off[row] : off[row + 1]].tobytes().decode()
                    whole[row] = any(c in text for c in _ODD_WIDE)
        mark = np.flatnonzero(_MARK_BYTES[buf])
        if len(mark):
            # of each run of marks: its first, and whether white space or the text's end follows
            run = np.flatnonzero(np.concatenate(([True], (np.diff(mark) != 1) | text_start[mark[1:]])))
            start, end = mark[run], mark[np.append(run[1:], len(mark)) - 1] + 1
            letter = _LETTER_BYTES[buf[start - 1]] | (buf[start - 2] == 0xC3) & _LATIN_BYTES[buf[start - 1]]
            last = text_start[end] | white[np.minimum(end, len(buf) - 1)]
            begins[start[letter & last & ~text_start[start] & (start > 1)]] = True
        if whole.any():
            begins &= ~np.repeat(whole, np.diff(off))
        begins[off[:-1][off[:-1] < len(buf)]] = False
        inner = np.flatnonzero(begins)
        cuts = np.sort(np.concatenate((off[:-1], inner)), kind="stable")
        first = np.arange(n) + np.searchsorted(inner, off[:-1])
        return np.append(cuts, len(buf)), first

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        found = list(map(self.known.get, pieces))
        if None in found:
            need = list(compress(pieces, [x is None for x in found]))
            if len(self.known) + len(need) > KEPT_WORDS:  # what was known becomes what was known before; words in use stay
                self.before, self.known, need = self.known, {}, pieces
            before, fresh = self.before, []
            for w in need:
                ids = before.get(w)
                if ids is None:
                    fresh.append(w)
                else:
                    self.known[w] = ids
            once = self._learn(fresh)
            found = [once[w] if w in once else self.known[w] for w in pieces] if once else list(map(self.known.__getitem__, pieces))
        return found

    def _learn(self, need: list[str]) -> dict[str, bytes]:
        """Encodes pieces. A plain word and the punctuation after it are looked up apart, as the tokenizers cut there.
        Returns what is too long to keep."""
        known, before = self.known, self.before
        parts: list[tuple[str, str, str]] = []
        plain, lines, others = [], [], []
        new: set[str] = set()
        for w in need:
            if w[1:].isalpha() and w[0] in " \n":
                core = w
            else:
                core = w.rstrip(_MARKS)
            lead, bare = core[:1], core[1:]
            if lead in " \n" and bare.isalpha() and (bare.isascii() or (max(bare) < "ɐ" and "İ" not in bare)):
                if not self.keeps_space:
                    core = " " + bare
                if core != w:
                    parts.append((w, core, w[1 + len(bare) :]))
                if core not in known and core not in new:
                    if core in before:
                        known[core] = before[core]
                    else:
                        new.add(core)
                        (lines if core[0] == "\n" else plain).append(core)
            else:
                others.append(w)
        self._learn_plain(plain, self.edge)
        self._learn_plain(lines, np.arange(len(self.edge)) == self.line_feed)
        tails = list({t for _, _, t in parts})
        batch = self.tokenizer.encode_batch_fast(others + tails, add_special_tokens=False)
        ids = [np.array(e.ids, "<u4").tobytes() for e in batch]
        tail = dict(zip(tails, ids[len(others) :], strict=True))
        known.update([(w, known[core] + tail[t]) for w, core, t in parts])
        once = {w: x for w, x in zip(others, ids, strict=False) if len(w) > LONGEST_KEPT}
        known.update([(w, x) for w, x in zip(others, ids, strict=False) if len(w) <= LONGEST_KEPT])
        return once

    def _learn_plain(self, words: list[str], edge: np.ndarray) -> None:
        """Words of plain letters with the blank or line feed before them, encoded many in one text; ``edge`` are the
        tokens that begin, or without blanks end, each of them."""
        if not words:
            return
        texts = ["".join(words[a : a + 128]) for a in range(0, len(words), 128)]
        batch = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in batch])
        at = np.flatnonzero(edge[ids]) * 4
        cuts = [*at.tolist(), 4 * len(ids)] if self.keeps_space else [0, *(at + 4).tolist()]
        if len(cuts) != len(words) + 1 or cuts[0] != 0 or cuts[-1] != 4 * len(ids):
            raise RuntimeError("the tokenizer doesn't cut plain words at blanks")
        data = ids.tobytes()
        self.known.update(zip(words, map(data.__getitem__, map(slice, cuts[:-1], cuts[1:])), strict=True))
