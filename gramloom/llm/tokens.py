"""Ids of a byte-level BPE tokenizer for whole batches of texts, in memory that does not grow with the texts.

The tokenizer splits a text into short pieces (word with its leading blank, number, run of signs, white space)
and merges bytes within each. Natural text repeats pieces, so texts are cut by array operations on their code
points, and the distinct pieces are looked up in a table of pieces seen before; only new ones go through
the tokenizer. Which class a character belongs to is asked of the tokenizer itself, once for each character.

Pieces of up to eight ASCII characters are found by these themselves, others by a hash; such a piece counts as found
only if all its code points equal those of the table, so equal hashes of different pieces cost time and no result.

Long texts are read in stretches of ``CHUNK`` code points. The last two pieces of a stretch may change with what
follows (a word goes on, an apostrophe takes a short form), so they are left to the next one. One piece of any
length is encoded whole, as the tokenizer does. Strings of special tokens cut the text, as in the tokenizer.
Tokenizers of another build encode whole texts.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np

from gramloom.llm.common import give_back
from gramloom.llm.textkit import span_hashes

#: Code points cut at once, at some 70 bytes each.
CHUNK = 1 << 18
#: Pieces, ids and code points that the table holds (34 MB in all); a full one starts anew.
TABLE, TABLE_IDS, TABLE_POINTS = 1 << 19, 1 << 21, 1 << 22
#: Longer pieces are encoded each time.
LONGEST = 64
#: Short forms the tokenizer splits off after an apostrophe. Fixed values of the public pre-tokenization pattern.
SHORT_FORMS = ("s", "t", "re", "ve", "m", "ll", "d")
HASHED, HIGH = np.uint64(1 << 63), np.uint64(0x8080808080808080)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: The character that byte-level BPE writes for each byte: printable ones stand for themselves, others follow from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARACTERS = np.array([b if b in _PRINTABLE else 256 + sum(c not in _PRINTABLE for c in range(b)) for b in range(256)], "<u4")
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all spans, one after the other."""
    total = np.cumsum(lengths)
    n = int(total[-1]) if len(total) else 0
    return np.arange(n) - np.repeat(total - lengths, lengths) + np.repeat(starts, lengths)


def _keys(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A key of each piece: up to eight ASCII characters themselves, else a hash with the first bit set."""
    n = len(points)
    bytes_ = np.zeros(n + 8, np.uint8)
    bytes_[:n] = np.where((points < 128) & (points > 0), points, 128)
    eight = np.lib.stride_tricks.as_strided(bytes_.view()[: n + 1], (n, 8), (1, 1))[starts].reshape(-1).view("<u8")
    keys = eight & _MASKS[np.minimum(lengths, 8)]
    long = np.flatnonzero((lengths > 8) | ((keys & HIGH) != 0))
    # The code points of these pieces, close together, so that only they are hashed.
    n_long = lengths[long]
    own = points[_spans(starts[long], n_long)]
    ends = np.cumsum(n_long)
    keys[long] = span_hashes(own, ends - n_long, ends) | HASHED if len(long) else 0
    return keys


class _Table:
    """Pieces by hash, with their code points and ids."""

    def __init__(self):
        self.keys, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted keys and their entries
        self.size = self.n_ids = self.n_points = 0
        self.id_at, self.id_n = np.zeros(TABLE, np.int32), np.zeros(TABLE, np.int32)
        self.point_at, self.point_n = np.zeros(TABLE, np.int32), np.zeros(TABLE, np.int32)
        self.ids, self.points = np.zeros(TABLE_IDS, np.int32), np.zeros(TABLE_POINTS, np.uint32)

    def find(self, keys: np.ndarray, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The entry of each piece, -1 where there is none."""
        if not self.size:
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), self.size - 1)
        entry = np.where(self.keys[at] == keys, self.order[at], -1)
        entry[(entry >= 0) & (self.point_n[entry] != lengths)] = -1
        there = np.flatnonzero((entry >= 0) & (keys >= HASHED))
        own, n = entry[there], lengths[there]
        wrong = self.points[_spans(self.point_at[own], n)] != points[_spans(starts[there], n)]
        entry[there[np.repeat(np.arange(len(there)), n)[wrong]]] = -1
        return entry

    def add(self, keys: np.ndarray, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, n_ids: np.ndarray) -> None:
        """Takes pieces that it doesn't hold, as far as there is room (of equal keys the first stays)."""
        places = np.minimum(np.searchsorted(self.keys, keys), max(self.size - 1, 0))
        fits = (lengths <= LONGEST) & ((self.keys[places] != keys) if self.size else True)
        if not fits.all():
            ids = ids[np.repeat(fits, n_ids)]
            keys, starts, lengths, n_ids = keys[fits], starts[fits], lengths[fits], n_ids[fits]
        own = points[_spans(starts, lengths)]
        a, b, c = self.size, self.n_ids, self.n_points
        if a + len(keys) > TABLE or b + len(ids) > TABLE_IDS or c + len(own) > TABLE_POINTS:
            self.keys, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int32)
            self.size = self.n_ids = self.n_points = a = b = c = 0
            if len(keys) > TABLE or len(ids) > TABLE_IDS or len(own) > TABLE_POINTS:
                return
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.order = np.insert(self.order, where, np.arange(a, a + len(keys), dtype=np.int32))
        self.size, self.n_ids, self.n_points = a + len(keys), b + len(ids), c + len(own)
        self.id_at[a : self.size], self.id_n[a : self.size] = b + np.cumsum(n_ids) - n_ids, n_ids
        self.point_at[a : self.size], self.point_n[a : self.size] = c + np.cumsum(lengths) - lengths, lengths
        self.ids[b : self.n_ids], self.points[c : self.n_points] = ids, own


class BatchTokenizer:
    """Encodes texts with a tokenizer given by its JSON text."""

    def __init__(self, json_text: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json_text)
        made = json.loads(json_text)
        split, added = made.get("pre_tokenizer") or {}, made.get("added_tokens") or []
        self.by_pieces = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and not made.get("normalizer")
            and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        self.special = {t["content"]: np.array([t["id"]], np.int32) for t in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.table = _Table()

    def _learn_classes(self, points: np.ndarray) -> None:
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for p in points.tolist():
            c = chr(p)
            if c == "'":
                kind = OTHER
            elif len(pieces("a" + c)) == 1:
                kind = LETTER
            elif len(pieces("1" + c)) == 1:
                kind = NUMBER
            elif len(pieces("!" + c)) == 1:
                kind = OTHER
            else:
                kind = SPACE
            self.classes[p] = kind

    def _cuts(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Starts of all pieces; ``ends``: where each text ends."""
        n = len(points)
        kinds = self.classes[points]
        if (kinds == UNKNOWN).any():
            self._learn_classes(np.unique(points[kinds == UNKNOWN]))
            kinds = self.classes[points]
        begin = np.zeros(n + 1, bool)
        begin[0] = True
        begin[ends[ends < n]] = True
        begin = begin[:n]
        last = np.ones(n, bool)  # last character of its text
        last[:-1] = begin[1:]
        space = kinds == SPACE
        start = begin.copy()
        start[1:] |= kinds[1:] != kinds[:-1]
        # The last white space before a word goes with it, if it is a blank, or else stands alone.
        before_word = np.zeros(n, bool)
        before_word[:-1] = space[:-1] & ~space[1:] & ~last[:-1]
        start |= before_word
        joins = before_word & (points == 32)
        start[1:][joins[:-1]] = False
        # Short forms: an apostrophe that starts its piece, by itself.
        mark = np.flatnonzero((points == 39) & start & ~last)
        for form in SHORT_FORMS if len(mark) else ():
            at = mark[mark + len(form) < n]
            fits = np.ones(len(at), bool)
            for j, c in enumerate(form, 1):
                fits &= (points[at + j] == ord(c)) & ~begin[at + j]
            at = at[fits]
            start[at + 1] = False
            after = at + len(form) + 1
            start[after[after < n]] = True
        return np.flatnonzero(start)

    def _through(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces by the tokenizer's model, and the number of ids of each."""
        own = points[_spans(starts, lengths)]
        width = 1 + (own >= 0x80) + (own >= 0x800) + (own >= 0x10000)
        ends = np.append(0, np.cumsum(width))[np.cumsum(lengths)].tolist()
        raw = np.frombuffer(own.tobytes().decode("utf-32-le").encode(), np.uint8)
        text = _BYTE_CHARACTERS[raw].tobytes().decode("utf-32-le")
        merge = self.tokenizer.model.tokenize
        got = [[t.id for t in merge(text[a:b])] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
        n_ids = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), np.int32, int(n_ids.sum())), n_ids

    def _of_pieces(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and the number of ids of each."""
        lengths = np.diff(np.append(starts, len(points)))
        whole = _keys(points, starts, lengths)
        keys, first, back = np.unique(whole, return_index=True, return_inverse=True)
        # Pieces that have the hash of another one, but not its code points, are pieces of their own.
        like = first[back]
        other = lengths[like] != lengths
        same = np.flatnonzero((whole >= HASHED) & ~other & (like != np.arange(len(like))))
        wrong = points[_spans(starts[same], lengths[same])] != points[_spans(starts[like[same]], lengths[same])]
        other[same[np.repeat(np.arange(len(same)), lengths[same])[wrong]]] = True
        odd = np.flatnonzero(other)
        back[odd] = len(keys) + np.arange(len(odd))
        at, n = starts[first], lengths[first]
        entry = self.table.find(keys, points, at, n)
        known, new = np.flatnonzero(entry >= 0), np.flatnonzero(entry < 0)
        known_ids = self.table.ids[_spans(self.table.id_at[entry[known]], self.table.id_n[entry[known]])]
        known_n = self.table.id_n[entry[known]]
        ids, n_ids = self._through(points, np.append(at[new], starts[odd]), np.append(n[new], lengths[odd]))
        if len(new):
            in_table = int(n_ids[: len(new)].sum())
            self.table.add(keys[new], points, at[new], n[new], ids[:in_table], n_ids[: len(new)])
        # Distinct pieces in the order known, new, odd; ``back`` counts them in the order of keys, then odd.
        rank = np.empty(len(keys) + len(odd), np.int64)
        rank[np.concatenate([known, new, len(keys) + np.arange(len(odd))])] = np.arange(len(rank))
        flat, count = np.concatenate([known_ids, ids]), np.concatenate([known_n, n_ids])
        begin = np.cumsum(count) - count
        piece = rank[back]
        return flat[_spans(begin[piece], count[piece])], count[piece]

    def _short(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts that aren't empty and together are short."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(t) for t in texts])
        starts = self._cuts(points, ends)
        ids, n_ids = self._of_pieces(points, starts)
        total = np.append(0, np.cumsum(n_ids))
        return np.split(ids, total[np.searchsorted(starts, ends[:-1])])

    def _long(self, text: str) -> np.ndarray:
        at, width, out = 0, CHUNK, []
        while at < len(text):
            points = np.frombuffer(text[at : at + width].encode("utf-32-le"), "<u4")
            starts = self._cuts(points, np.array([len(points)]))
            if at + width < len(text):
                if len(starts) <= 2:  # a piece longer than the stretch
                    width *= 2
                    continue
                points, starts = points[: starts[-2]], starts[:-2]
            out.append(self._of_pieces(points, starts)[0])
            at, width = at + len(points), CHUNK
        return np.concatenate(out)

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as int32."""
        batch: list[str] = []
        size = 0
        for text in texts:
            special = self.special_cut is not None and self.special_cut.search(text)
            alone = special or not self.by_pieces or not text or len(text) > CHUNK
            if batch and (alone or size + len(text) > CHUNK):
                yield from self._short(batch)
                batch, size = [], 0
            if not alone:
                batch.append(text)
                size += len(text)
            elif not text:
                yield np.zeros(0, np.int32)
            elif not self.by_pieces:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
            elif special:
                parts = self.special_cut.split(text)
                parts[1::2] = [self.special[p] for p in parts[1::2]]
                parts[::2] = [self._long(p) if p else np.zeros(0, np.int32) for p in parts[::2]]
                yield np.concatenate(parts)
            else:
                yield self._long(text)
        if batch:
            yield from self._short(batch)


_made: dict[str, BatchTokenizer] = {}


def batch_tokenizer(json_text: str) -> BatchTokenizer:
    """One tokenizer for each worker process, with what it has learnt so far."""
    if json_text not in _made:
        _made.clear()
        _made[json_text] = BatchTokenizer(json_text)
        give_back()  # reading the JSON took more than the tokenizer takes
    return _made[json_text]
