"""Offset-preserving SentencePiece encoding and decoding (operator 4).

A piece model (``.model``) is read as it stands: its pieces, scores and normaliser. Encoding has three steps.

* Normalisation walks the compiled character map (a double-array trie over UTF-8) from each position to its
  longest prefix, replaces it, and records for every byte of the result which byte of the text it stems from.
  All positions of a batch walk together, one byte at a time; a map that is empty matches nowhere. White space
  rules of the model (dummy prefix, runs, escape by U+2581) are part of it.
* Pieces are merged from characters by score, best first, then leftmost. What no piece covers becomes bytes.
  Pieces of the model never hold U+2581 after another character (checked when it is read), so merges never
  cross word starts: the distinct words of a batch are merged together, those of one length in one matrix.
* Every piece ends at a byte of the normalised text; the recorded alignment projects it to the original bytes.

Decoding joins surfaces: U+2581 is a space, the dummy prefix goes, runs of byte pieces are UTF-8 with U+FFFD
for each byte that doesn't fit, control pieces are silent.

Each row is coded by itself in Arrow batches: nothing is shuffled, and a worker remembers nothing of texts. The
model (half a megabyte) is read once by the driver and rides in the function.

Defined cases: null text counts as empty, which has begin and end ids only and no spans; texts are coded
whole, whatever their length; repeated rows are coded alike; an empty table gives an empty result. One very long text
is coded in stretches, cut between two characters that stand together in no piece, so that no merge crosses a cut (white space
after a word is such a place), and takes about three bytes of Python memory for each of its bytes. That needs a model whose map is
empty and which keeps all white space, as the public one does; with others, and within a run of characters that pieces could join
all along, it takes about 50. Columns beside those asked for never matter, whatever their names.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import io
import itertools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import table

SPACE = "▁".encode()
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Rank of neighbours that make no piece.
_NONE = np.iinfo(np.int32).max
#: More than there are ids and code points together.
_SPREAD = 1 << 31
_BYTE_PIECE = re.compile(rb"<0x([0-9A-F]{2})>")


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = buf[at]
        value |= (b & 127) << shift
        at += 1
        if b < 128:
            return value, at
        shift += 7


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message; fixed-width fields come as their bytes."""
    at = 0
    while at < len(buf):
        tag, at = _varint(buf, at)
        if tag & 7 == 0:
            value, at = _varint(buf, at)
        else:
            size, at = _varint(buf, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = buf[at : at + size], at + size
        yield tag >> 3, value


class CharacterMap:
    """The compiled character map: a double-array trie of prefixes and the pool of what replaces them."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4")
        self.pool = blob[4 + size :]

    def replaced(self, at: int) -> bytes:
        return self.pool[at : self.pool.index(b"\0", at)]

    def longest(self, data: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a known prefix starts, how long the longest one is, and where what replaces it stands in the pool.

        ``limit`` says for each byte where its text ends. Positions inside a match that begins before them are left out.
        """
        none = np.empty(0, np.int64)
        if not len(self.units) or not len(data):
            return none, none, none
        size, value = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        alive = np.flatnonzero((data & 0xC0) != 0x80)
        place = np.full(len(alive), _offset(self.units[:1])[0], np.uint32)
        depth = 0
        while len(alive):
            place = place ^ data[alive + depth]
            node = self.units[place]
            on = (node & np.uint32(0x800000FF)) == data[alive + depth]
            alive, place, node = alive[on], place[on], node[on]
            place = place ^ _offset(node)
            depth += 1
            ends = (node >> np.uint32(8)) & np.uint32(1) == 1
            size[alive[ends]], value[alive[ends]] = depth, self.units[place[ends]] & np.uint32(0x7FFFFFFF)
            on = alive + depth < limit[alive]
            alive, place = alive[on], place[on]
        chosen, free = [], 0
        for start in np.flatnonzero(size).tolist():
            if start >= free:
                chosen.append(start)
                free = start + int(size[start])
        starts = np.array(chosen, np.int64)
        return starts, size[starts], value[starts]


def _offset(node: np.ndarray) -> np.ndarray:
    return (node >> np.uint32(10)) << ((node & np.uint32(512)) >> np.uint32(6))


class Model:
    """A piece model: BPE with optional byte fallback."""

    def __init__(self, blob: bytes):
        self.pieces: list[bytes] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        charsmap, self.dummy_prefix, self.remove_extra, self.escape = b"", True, True, True
        self.unk_surface = " ⁇ ".encode()
        kind, suffix = 1, 0
        for field, value in _fields(blob):
            if field == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
                self.pieces.append(piece[1])
                self.scores.append(float(np.frombuffer(piece[2], "<f4")[0]))
                self.types.append(piece[3])
            elif field == 2:
                spec = dict(_fields(value))
                kind, suffix, self.unk_surface = spec.get(3, 1), spec.get(24, 0), spec.get(44, self.unk_surface)
            elif field == 3:
                spec = dict(_fields(value))
                charsmap = spec.get(2, b"")
                self.dummy_prefix, self.remove_extra, self.escape = (bool(spec.get(i, 1)) for i in (3, 4, 5))
        if kind != 2 or suffix or USER in self.types or UNUSED in self.types:
            raise ValueError("only BPE models without user-defined or unused pieces, with white space as prefix, are supported")
        self.map = CharacterMap(charsmap)
        normal = [(p, i) for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL]
        self.ids = {p.decode(): i for p, i in normal}
        self.sizes = [len(p) for p in self.pieces]
        order = {s: n for n, s in enumerate(sorted({self.scores[i] for _, i in normal}, reverse=True))}
        self.rank = {p.decode(): order[self.scores[i]] for p, i in normal}
        self.byte_ids = {int(_BYTE_PIECE.fullmatch(p)[1], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.unk = self.types.index(UNKNOWN)
        named = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == CONTROL}
        self.begin, self.end = named.get(b"<s>"), named.get(b"</s>")
        mark = SPACE.decode()
        self.by_word = not any(mark in p.lstrip(mark) for p in self.rank)
        #: Characters that stand together in a piece, and whether a text can be coded in stretches cut between others.
        self.joined = {pair for p in self.rank for pair in itertools.pairwise(p)}
        self.by_stretch = not len(self.map.units) and self.escape and self.dummy_prefix and not self.remove_extra and mark in self.ids
        surface = [b"" if t == CONTROL else self.unk_surface if t == UNKNOWN else bytes([int(_BYTE_PIECE.fullmatch(p)[1], 16)]) if t == BYTE
                   else p.replace(SPACE, b" ") for p, t in zip(self.pieces, self.types, strict=True)]
        self.surface = surface
        self.is_byte = np.array([t == BYTE for t in self.types])
        self.is_special = np.array([t in (UNKNOWN, CONTROL) for t in self.types])
        self.starts_word = np.array([t == NORMAL and p.startswith(SPACE) for p, t in zip(self.pieces, self.types, strict=True)])
        self.surface_pool = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_sizes = np.array([len(x) for x in surface], np.int64)
        self.surface_starts = np.cumsum(self.surface_sizes) - self.surface_sizes
        self._tabulate()

    def _tabulate(self) -> None:
        """For merging in matrices: ids of single characters, and for pairs of pieces that make a piece its rank and id."""
        self.of_character = np.full(0x110000, -1, np.int32)
        found: dict[int, tuple[int, int]] = {}
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_character[ord(piece)] = i
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    found[a * _SPREAD + b] = self.rank[piece], i
        self.pair_keys = np.array(sorted(found), np.int64)
        self.pair_rank, self.pair_id = (np.array([found[k][j] for k in self.pair_keys.tolist()] + [_NONE], np.int32) for j in range(2))
        self.piece_sizes = np.array(self.sizes, np.int64)

    def normalize(self, data: np.ndarray, bounds: np.ndarray, begins: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Many texts, cut from ``data`` at ``bounds``: their normalised bytes, the byte of ``data`` that each stems from, the
        bounds of the texts among them, and where in ``data`` what is left of each text ends. The dummy prefix is for texts that ``begin`` there."""
        starts, widths, values = self.map.longest(data, np.repeat(bounds[1:], np.diff(bounds)))
        # Each byte makes one byte; the first byte of a match makes all that replaces it, and its others none.
        makes = np.ones(len(data), np.int64)
        makes[np.repeat(starts - (np.cumsum(widths) - widths), widths) + np.arange(int(widths.sum()))] = 0
        known = {v: np.frombuffer(self.map.replaced(v), np.uint8) for v in np.unique(values).tolist()}
        put = [known[v] for v in values.tolist()]
        makes[starts] = [len(x) for x in put]
        origin = np.repeat(np.arange(len(data)), makes)
        out, stop = data[origin], np.append(0, np.cumsum(makes))
        if put:
            n = makes[starts]
            out[np.repeat(stop[starts] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = np.concatenate(put)
        stops, heads, tails = stop[bounds], bounds[:-1], bounds[1:]
        if self.remove_extra:
            whole = (makes > 0) | np.isin(np.arange(len(data)), starts)  # where a character or a match starts, or a byte of its own
            blank = (makes == 1) & (np.append(out, 0)[np.minimum(stop[:-1], len(out))] == 32)
            heads = np.append(np.flatnonzero(whole & ~blank), len(data))
            heads = heads[np.searchsorted(heads, bounds[:-1])]
            out, origin, stops, tails = self._without_extra(out, origin, stops, tails)
        mark = np.frombuffer(SPACE if self.escape else b" ", np.uint8)
        if self.dummy_prefix and begins:
            some = np.flatnonzero((np.diff(stops) > 0) if self.remove_extra else (np.diff(bounds) > 0))
            at = np.repeat(stops[some], len(mark))
            out, origin = np.insert(out, at, np.tile(np.uint8(32), len(at))), np.insert(origin, at, np.repeat(heads[some], len(mark)))
            added = np.zeros(len(stops), np.int64)
            added[some + 1] = len(mark)
            stops = stops + np.cumsum(added)
            out[np.repeat(stops[some], len(mark)) + np.tile(np.arange(len(mark)), len(some))] = np.tile(mark, len(some))
        if self.escape:
            makes = np.where(out == 32, len(mark), 1)
            stop = np.append(0, np.cumsum(makes))
            spaces = stop[:-1][out == 32]
            out, origin, stops = np.repeat(out, makes), np.repeat(origin, makes), stop[stops]
            for j, c in enumerate(mark.tolist()):
                out[spaces + j] = c
        return out, origin, stops, tails

    def _without_extra(self, out: np.ndarray, origin: np.ndarray, stops: np.ndarray, tails: np.ndarray):
        """Runs of spaces become one, and spaces at both ends go; with the escape, marks that the text itself ends with go as well."""
        space = out == 32
        before = np.append(True, space)[:-1]
        before[stops[:-1][np.diff(stops) > 0]] = True
        keep, tails = ~(space & before), tails.copy()
        for i in np.flatnonzero(np.diff(stops) > 0).tolist():
            last = stops[i + 1]
            while last > stops[i]:
                if space[last - 1]:
                    last -= 1
                elif self.escape and last - 3 >= stops[i] and out[last - 3 : last].tobytes() == SPACE:
                    last -= 3
                else:
                    break
            if last < stops[i + 1]:
                keep[last : stops[i + 1]] = False
                tails[i] = origin[last]
        return out[keep], origin[keep], np.append(0, np.cumsum(keep))[stops], tails

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and byte lengths of all words' pieces in a row, and the number of each word's pieces."""
        data = b"".join(words)
        points = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        bounds = np.cumsum([0, *map(len, words)])
        begins = np.append(0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))[bounds]
        # A character that is no piece keeps its code point, beyond all ids: it merges with nothing.
        known = self.of_character[points]
        ids = np.where(known >= 0, known, len(self.pieces) + points)
        lengths = np.diff(begins)
        number, parts = np.zeros(len(words), np.int64), []
        for length in np.flatnonzero(np.bincount(lengths[(lengths > 0) & (lengths <= 48)])).tolist():
            which = np.flatnonzero(lengths == length)
            left, count = self._merge_matrix(ids[begins[which][:, None] + np.arange(length)])
            number[which] = count
            parts.append((which, count, left[np.arange(length) < count[:, None]]))
        for i in np.flatnonzero(lengths > 48).tolist():
            text = data[bounds[i] : bounds[i + 1]].decode("utf-8", "surrogatepass")
            own = np.array([self.ids[p] if p in self.ids else len(self.pieces) + ord(p) for p in _merged_long(list(text), self.rank)], np.int64)
            number[i] = len(own)
            parts.append((np.array([i]), np.array([len(own)]), own))
        out = np.empty(int(number.sum()), np.int64)
        first = np.cumsum(number) - number
        for which, count, own in parts:
            out[np.repeat(first[which] - (np.cumsum(count) - count), count) + np.arange(len(own))] = own
        return self._with_bytes(out, number)

    def _with_bytes(self, ids: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters that are no piece become their bytes, or the unknown piece where the model has no bytes."""
        strange = np.flatnonzero(ids >= len(self.pieces))
        sizes = self.piece_sizes[np.minimum(ids, len(self.pieces) - 1)]
        if not len(strange):
            return ids.astype("<u4"), sizes, number
        raw = {p: chr(p - len(self.pieces)).encode("utf-8", "surrogatepass") for p in np.unique(ids[strange]).tolist()}
        put = [raw[p] for p in ids[strange].tolist()]
        if not self.byte_ids:
            ids[strange], sizes[strange] = self.unk, [len(x) for x in put]
            return ids.astype("<u4"), sizes, number
        makes = np.ones(len(ids), np.int64)
        makes[strange] = [len(x) for x in put]
        stop = np.append(0, np.cumsum(makes))
        number = np.diff(stop[np.append(0, np.cumsum(number))])
        ids, sizes = np.repeat(ids, makes), np.repeat(sizes, makes)
        n = makes[strange]
        at = np.repeat(stop[strange] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        ids[at] = [self.byte_ids[c] for x in put for c in x]
        # The bytes of one character share its place; the last one ends it.
        sizes[at] = 0
        sizes[stop[strange + 1] - 1] = n
        return ids.astype("<u4"), sizes, number

    def _merge_matrix(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge each row's best-ranked neighbours, leftmost first, until none is a piece: the rows, and how much of them is left."""
        rows, width = ids.shape
        ids, count = ids.copy(), np.full(rows, width)
        if width == 1:
            return ids, count
        rank, made = self._pairs(ids[:, :-1], ids[:, 1:])
        todo = np.arange(rows)
        place = np.arange(width - 1)
        while len(todo):
            best = rank[todo].argmin(axis=1)
            on = rank[todo, best] < _NONE
            todo, best = todo[on], best[on]
            if not len(todo):
                break
            count[todo] -= 1
            new = made[todo, best]
            # What stands behind the merged pair moves up by one.
            behind = place >= best[:, None] + 1
            ids[todo, :-1] = np.where(behind, ids[todo, 1:], ids[todo, :-1])
            ids[todo, best] = new
            for x, empty in ((rank, _NONE), (made, 0)):
                x[todo, :-1] = np.where(behind[:, :-1] | (place[:-1] == best[:, None]), x[todo, 1:], x[todo, :-1])
                x[todo, -1] = empty
            for left in (best - 1, best):
                fits = (left >= 0) & (left + 1 < count[todo])
                r, at = todo[fits], left[fits]
                rank[r, at], made[r, at] = self._pairs(ids[r, at], ids[r, at + 1])
        return ids, count

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a * _SPREAD + b
        at = np.searchsorted(self.pair_keys, key)
        at[at >= len(self.pair_keys)] = 0
        at = np.where(self.pair_keys[at] == key, at, -1) if len(self.pair_keys) else np.full(key.shape, -1)
        return self.pair_rank[at], self.pair_id[at]

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces, and where each begins and ends in the bytes of ``text``."""
        return self.encode_batch(pa.array([text], pa.binary()))[:3]

    def stretches(self, text: bytes, size: int) -> Iterator[bytes]:
        """``text`` in stretches of about ``size`` bytes, cut where no merge crosses."""
        at = 0
        while at < len(text):
            cut = at + size
            while cut < len(text) and self._may_join(text, cut):
                cut += 1
            yield text[at:cut]
            at = cut

    def _may_join(self, text: bytes, cut: int) -> bool:
        """Whether a merge could cross ``cut``, or a character does."""
        if text[cut] & 0xC0 == 0x80:
            return True
        before = cut - 1
        while text[before] & 0xC0 == 0x80 and before > cut - 4:
            before -= 1
        pair = text[before : cut + 4].decode("utf-8", "ignore")[:2].replace(" ", SPACE.decode())
        return len(pair) < 2 or tuple(pair) in self.joined

    def encode_batch(self, texts: pa.Array, begins: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Many texts at once: ids, begins and ends of all pieces, and where each text's pieces start and stop.

        The normalised texts are cut into words, each distinct word is merged once, and what they stand for is gathered.
        """
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        bounds = np.append(0, np.cumsum(sizes))
        data = np.frombuffer(b"".join(pc.fill_null(texts, b"").to_pylist()), np.uint8)
        norm, origin, stops, tails = self.normalize(data, bounds, begins)
        cuts = self._word_starts(norm, stops)
        words = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(norm)).astype(np.int32)), pa.py_buffer(norm.tobytes())])
        coded = words.dictionary_encode()
        which = coded.indices.to_numpy()
        pool, pool_sizes, number = self.merged(coded.dictionary.to_pylist())
        n = number[which]
        stop = np.cumsum(n)
        total = int(stop[-1]) if len(stop) else 0
        at = np.repeat((np.cumsum(number) - number)[which] - (stop - n), n) + np.arange(total)
        ids, ends = pool[at], np.cumsum(pool_sizes[at])
        limits = np.append(0, stop)[np.searchsorted(cuts, stops)]
        begins = np.append(0, ends)[:-1]
        begins, ends = origin[begins], np.append(origin, len(data))[ends]
        some = np.diff(limits) > 0
        ends[limits[1:][some] - 1] = tails[some]
        base = np.repeat(bounds[:-1], np.diff(limits))
        return ids, begins - base, ends - base, limits

    def _word_starts(self, norm: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Where words start: at each run of U+2581, and at each text."""
        texts = stops[:-1][np.diff(stops) > 0]
        if not self.by_word:
            return texts
        marks = np.flatnonzero((norm[:-2] == SPACE[0]) & (norm[1:-1] == SPACE[1]) & (norm[2:] == SPACE[2])) if len(norm) > 2 else np.empty(0, np.int64)
        # A mark inside a run starts no word, unless it starts a text.
        starts = np.zeros(len(norm), bool)
        starts[marks[np.append(True, np.diff(marks) != 3)] if len(marks) else marks] = True
        starts[texts] = True
        return np.flatnonzero(starts)

    def surfaces(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all pieces in a row, and where each piece's end."""
        size = self.surface_sizes[ids]
        stop = np.cumsum(size)
        at = np.repeat(self.surface_starts[ids] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)
        return self.surface_pool[at], stop

    def decode_batch(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of many sequences of ids. Those that hold pieces without a surface of their own, begin otherwise than with a word,
        or whose bytes are no UTF-8, are decoded one by one."""
        data, stop = self.surfaces(ids)
        stop = np.append(0, stop)[bounds]
        some = np.diff(bounds) > 0
        special = np.append(0, np.cumsum(self.is_special[ids]))[bounds]
        simple = some & (np.diff(special) == 0) & self.dummy_prefix & (not self.remove_extra)
        simple[some] &= self.starts_word[ids[bounds[:-1][some]]]
        # The dummy prefix goes: the first byte of each simple text.
        keep = np.ones(len(data), bool)
        keep[stop[:-1][simple]] = False
        kept, data = np.append(0, np.cumsum(keep))[stop], data[keep]
        raw = data.tobytes()
        try:
            raw.decode()
            broken = (np.append(data, 0)[kept[:-1]] & 0xC0) == 0x80
            simple &= ~(broken | np.append(broken[1:], False))
        except UnicodeDecodeError:
            for i in np.flatnonzero(simple).tolist():
                try:
                    raw[kept[i] : kept[i + 1]].decode()
                except UnicodeDecodeError:
                    simple[i] = False
        if simple.all():
            return pa.Array.from_buffers(pa.string(), len(kept) - 1, [None, pa.py_buffer(kept.astype(np.int32)), pa.py_buffer(raw)])
        cut = kept.tolist()
        return pa.array([raw[cut[i] : cut[i + 1]] if easy else self.decode(ids[bounds[i] : bounds[i + 1]]).encode("utf-8", "surrogatepass")
                         for i, easy in enumerate(simple.tolist())], pa.binary()).cast(pa.string())

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, control pieces included."""
        surface, pieces, types = self.surface, self.pieces, self.types
        runs = self.is_byte[ids].any()
        ids = ids.tolist()
        strip = self.dummy_prefix or self.remove_extra
        # Until there is text, a leading space goes: once, or all of them where the model removes extra ones.
        head, first = 0, b""
        while head < len(ids) and not first:
            i = ids[head]
            if types[i] == BYTE:
                break
            head += 1
            first = surface[i]
            if types[i] == NORMAL and strip and pieces[i].startswith(SPACE):
                first = first[1:]
                if not self.remove_extra:
                    break
        if not runs:
            return (first + b"".join(map(surface.__getitem__, ids[head:]))).decode("utf-8", "surrogatepass")
        # Bytes are read together where nothing, not even a silent piece, stands between them.
        grouped = itertools.groupby(ids[head:], lambda i: types[i] == BYTE)
        return first.decode() + "".join(_text_of(b"".join(map(surface.__getitem__, group))) for _, group in grouped)


def _merged_long(parts: list[str | None], rank: dict[str, int]) -> list[str]:
    """Merge the best-ranked neighbours, leftmost first, until none is a piece, with a heap: for words of any length."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, str]] = []

    def offer(i: int, j: int) -> None:
        both = parts[i] + parts[j]
        if (found := rank.get(both)) is not None:
            heapq.heappush(heap, (found, i, j, both))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if parts[i] is None or parts[j] is None or after[i] != j or len(parts[i]) + len(parts[j]) != len(both):
            continue
        parts[i], parts[j] = both, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            offer(i, after[i])
        if before[i] >= 0:
            offer(before[i], i)
    return [p for p in parts if p is not None]


def _text_of(data: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that doesn't fit."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("utf-8", "one_for_each")


def _one_for_each(e: UnicodeError):
    return "�" * (e.end - e.start), e.end


codecs.register_error("one_for_each", _one_for_each)


@functools.lru_cache(maxsize=1)
def load(blob: bytes) -> Model:
    return Model(blob)


def _code(blob: bytes, carry: list[str], spans: bool, tokens: bool, bytes_per_batch: int = 500_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(blob)
        for whole in batches:
            for batch in _bounded(whole, "text", bytes_per_batch):
                long = len(batch) == 1 and model.by_stretch and (batch.column("text")[0].as_buffer() or b"").size > bytes_per_batch
                yield code_long(model, batch) if long else code(model, batch)
        pa.default_memory_pool().release_unused()

    def code(model: Model, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, begins, ends, bounds = model.encode_batch(batch.column("text").cast(pa.binary()))
        lengths = np.diff(bounds)
        covered = np.where(lengths > 0, np.append(ends, 0)[np.maximum(bounds[1:] - 1, 0)], 0)
        framed = bounds + 2 * np.arange(len(bounds))
        sequences = np.empty(framed[-1], "<u4")
        sequences[framed[:-1]], sequences[framed[1:] - 1] = model.begin, model.end
        sequences[np.arange(len(ids)) + np.repeat(2 * np.arange(len(lengths)) + 1, lengths)] = ids
        places = np.stack([begins, ends], axis=1).astype("<u4").ravel()
        out = {
            "n_tokens": pa.array(lengths + 2, pa.int64()),
            "n_bytes": pa.array(covered, pa.int64()),
            "ids_sha256": _digests(sequences, framed),
            "spans_sha256": _digests(places, 2 * bounds),
            "decoded": model.decode_batch(ids, bounds),
        }
        if tokens:
            out["ids"] = _lists(sequences, framed)
        if spans:
            out |= {"begins": _lists(begins, bounds), "ends": _lists(ends, bounds)}
        kept = {c: batch.column(c) for c in carry}
        return pa.RecordBatch.from_arrays([*kept.values(), *out.values()], [*kept, *out])

    def code_long(model: Model, batch: pa.RecordBatch) -> pa.RecordBatch:
        """One text, a stretch at a time."""
        ends_at = [np.array([x], "<u4") for x in (model.begin, model.end)]
        n_tokens, n_bytes, sequence, places = 2, 0, hashlib.sha256(ends_at[0]), hashlib.sha256()
        decoded, lists = io.BytesIO(), ([ends_at[0]], [], [])
        mark = np.array([model.ids[SPACE.decode()]], "<u4")
        for part in model.stretches(batch.column("text")[0].as_buffer().to_pybytes(), bytes_per_batch):
            ids, begins, ends, _ = model.encode_batch(pa.array([part], pa.binary()), begins=not n_bytes)
            sequence.update(np.ascontiguousarray(ids, "<u4"))
            begins, ends = begins + n_bytes, ends + n_bytes
            places.update(np.stack([begins, ends], axis=1).astype("<u4").ravel())
            # The first piece of a later stretch begins no text: a mark that goes instead of the dummy prefix stands before it.
            shown = np.append(mark, ids) if n_bytes else ids
            decoded.write(model.decode_batch(shown, np.array([0, len(shown)]))[0].as_buffer())
            for kept, new, asked in zip(lists, (ids, begins, ends), (tokens, spans, spans), strict=True):
                if asked:
                    kept.append(new)
            n_tokens, n_bytes = n_tokens + len(ids), n_bytes + len(part)
        sequence.update(ends_at[1])
        lists[0].append(ends_at[1])
        text = pa.py_buffer(decoded.getbuffer())
        out = {
            "n_tokens": pa.array([n_tokens], pa.int64()),
            "n_bytes": pa.array([n_bytes], pa.int64()),
            "ids_sha256": pa.array([sequence.hexdigest()], pa.string()),
            "spans_sha256": pa.array([places.hexdigest()], pa.string()),
            "decoded": pa.Array.from_buffers(pa.string(), 1, [None, pa.py_buffer(np.array([0, text.size], np.int32)), text]),
        }
        for name, kept, asked in zip(("ids", "begins", "ends"), lists, (tokens, spans, spans), strict=True):
            if asked:
                values = np.concatenate(kept)
                out[name] = _lists(values, np.array([0, len(values)]))
        taken = {c: batch.column(c) for c in carry}
        return pa.RecordBatch.from_arrays([*taken.values(), *out.values()], [*taken, *out])

    return run


def _digests(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """SHA-256 of each stretch of 32-bit integers, little-endian."""
    raw = memoryview(np.ascontiguousarray(values, "<u4")).cast("B")
    return pa.array([hashlib.sha256(raw[lo:hi]).hexdigest() for lo, hi in itertools.pairwise((4 * bounds).tolist())], pa.string())


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.astype(np.int32), pa.int32()))


def _bounded(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``most`` bytes of text; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    group, long = (np.cumsum(sizes) - sizes) // most, sizes > most
    cuts = np.flatnonzero((np.diff(group) != 0) | long[1:] | long[:-1]) + 1
    for lo, hi in itertools.pairwise([0, *cuts.tolist(), len(batch)]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def model_bytes(spark: SparkSession, path: str) -> bytes:
    """A model from any file system that Spark reads; or from the driver's own disk where the path is plain."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, text_col: str = "text", carry: list[str] | None = None, spans: bool = True, tokens: bool = True) -> DataFrame:
    """``carry`` columns (default ``doc_id``), ``n_tokens, n_bytes, ids_sha256, spans_sha256, decoded`` and, where asked for, ``ids``
    with begin and end ids, and ``begins, ends``: the bytes of the original text that each piece between them stands for. ``n_bytes``
    is where the last piece ends; ``spans_sha256`` is the digest of begin and end of each piece in turn."""
    carry = carry or ["doc_id"]
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(text_col).cast("string").alias("text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["n_tokens long", "n_bytes long", "ids_sha256 string", "spans_sha256 string", "decoded string"]
    fields += ["ids array<int>"] * tokens + ["begins array<int>", "ends array<int>"] * spans
    return rows.mapInArrow(_code(model, carry, spans, tokens), ", ".join(fields))


def digests(coded: DataFrame, *carry: str) -> DataFrame:
    return coded.select(*carry, "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "n_bytes", "spans_sha256")


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentence_pieces(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    model = model_bytes(spark, model_path or public_model())
    return digests(encode(table(spark, sf_dir, "documents"), model, spans=False, tokens=False), "doc_id")


QUERIES = {"op4_sentence_pieces": op4_sentence_pieces}
#: Byte-pair merges have no form in SQL; tests hold ids, spans and decoded texts against the sentencepiece library.
ORACLES: dict[str, str] = {}
