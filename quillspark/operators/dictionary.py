"""Matches of large dictionaries in texts: one trie in flat arrays, walked from all places of a block of bytes at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

#: Places that are walked at once, bytes of text that a block holds at about, and a byte that no UTF-8 text has.
PLACES, BLOCK, GAP = 1 << 17, 1 << 18, 0xFF
#: Entries that the table of a level may have at most to be looked up directly, not searched.
DENSE = 1 << 22
#: The mark around a rendering.
MARK = "​"


class Trie:
    """The words of a dictionary, level by level: edges (node * 256 + byte) in order, and the node that each leads to.

    Nodes of a level are numbered by themselves. A level with few nodes is a table instead. Words are UTF-8, so that a
    match can only begin and end between characters.
    """

    def __init__(self, words: list[str]) -> None:
        self.words = words
        held = [w.encode() for w in words]
        sizes = np.array([len(w) for w in held], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if held else np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(held), np.uint8)
        self.levels: list[tuple[np.ndarray | None, np.ndarray, np.ndarray]] = []
        alive, node, nodes = np.flatnonzero(sizes > 0), np.zeros(int((sizes > 0).sum()), np.int64), 1
        depth = 0
        while len(alive):
            edges, node = np.unique(node * 256 + data[starts[alive] + depth], return_inverse=True)
            depth += 1
            whole = np.full(len(edges), -1, np.int32)
            ends = sizes[alive] == depth
            whole[node[ends]] = alive[ends]
            if nodes * 256 <= DENSE:
                table = np.full(nodes * 256, -1, np.int32)
                table[edges] = np.arange(len(edges), dtype=np.int32)
                self.levels.append((None, table, whole))
            else:
                self.levels.append((edges, np.arange(len(edges), dtype=np.int32), whole))
            nodes = len(edges)
            alive, node = alive[~ends], node[~ends]

    def matches(self, data: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, word) of all matches that begin at places start to stop; data ends with a GAP.

        Places whose walk has no edge left drop out, so the work is that of all common beginnings of words and texts.
        """
        places, nodes = np.arange(start, stop), np.zeros(stop - start, np.int64)
        found, words = [], []
        for depth, (edges, table, whole) in enumerate(self.levels):
            keys = nodes * 256 + data[places + depth]
            if edges is None:
                following = table[keys]
                alive = following >= 0
            else:
                following = np.minimum(np.searchsorted(edges, keys), len(edges) - 1)
                alive = edges[following] == keys
            places, nodes = places[alive], following[alive].astype(np.int64)
            if not len(places):
                break
            ends = whole[nodes]
            hit = ends >= 0
            found.append(places[hit])
            words.append(ends[hit])
        return (np.concatenate(found), np.concatenate(words)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32))


_built: dict[int, Trie] = {}


def trie_of(words: Broadcast) -> Trie:
    """The trie of broadcast words, built once in a worker."""
    key = words._jid if hasattr(words, "_jid") else id(words)
    if key not in _built:
        _built.clear()
        _built[key] = Trie(words.value)
    return _built[key]


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of runs of texts of about BLOCK bytes: each text's bytes, then a GAP. Null texts are empty."""
    at = 0
    while at < len(column):
        parts, size, row = [], 0, at
        while row < len(column) and (row == at or size < BLOCK):
            parts.append((column[row].as_py() or "").encode())
            size += len(parts[-1]) + 1
            row += 1
        offsets = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        yield at, offsets, np.frombuffer(bytes([GAP]).join([*parts, b""]), np.uint8)
        at = row


def found_in(trie: Trie, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, byte in it, word) of all matches in a block, by text and place, longer words first."""
    hits = [trie.matches(data, s, min(s + PLACES, len(data))) for s in range(0, len(data), PLACES)]
    places, words = (np.concatenate([h[i] for h in hits]) for i in (0, 1))
    text = np.searchsorted(offsets, places, side="right") - 1
    sizes = np.array([len(w.encode()) for w in trie.words], np.int64)
    order = np.lexsort((-sizes[words], places))
    return text[order], (places - offsets[text])[order], words[order]


def characters(data: np.ndarray, offsets: np.ndarray, text: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Which character of its text each byte begins, from 0."""
    begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return begun[offsets[text] + byte] - begun[offsets[text]]


def longest(places: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> list[int]:
    """Of matches by place, longer ones first, those taken from left to right without overlaps."""
    taken, free = [], 0
    for i, (place, word) in enumerate(zip(places.tolist(), words.tolist(), strict=True)):
        if place >= free:
            taken.append(i)
            free = place + int(sizes[word])
    return taken


def first_places(source: DataFrame, words: list[str]) -> DataFrame:
    """(doc, term, first_pos): each word that a text of rows (doc, text) contains, with its first 1-based place."""
    shipped = source.sparkSession.sparkContext.broadcast(words)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(shipped)
        names = pa.array(trie.words, pa.string())
        for batch in batches:
            for at, offsets, data in blocks(batch.column("text")):
                text, byte, word = found_in(trie, offsets, data)
                _, first = np.unique(text.astype(np.int64) * max(1, len(trie.words)) + word, return_index=True)
                first.sort()
                text, byte, word = text[first], byte[first], word[first]
                places = characters(data, offsets, text, byte) + 1
                columns = [batch.column("doc").take(pa.array(text + at)), names.take(pa.array(word)), pa.array(places.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "term", "first_pos"])

    return source.mapInArrow(search, f"doc {source.schema['doc'].dataType.simpleString()}, term string, first_pos int")


def spans(source: DataFrame, words: list[str]) -> DataFrame:
    """(doc, start, term): the matches in a text of rows (doc, text), leftmost and longest first, without overlaps; start from 0."""
    shipped = source.sparkSession.sparkContext.broadcast(words)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(shipped)
        names, sizes = pa.array(trie.words, pa.string()), np.array([len(w.encode()) for w in trie.words], np.int64)
        for batch in batches:
            for at, offsets, data in blocks(batch.column("text")):
                text, byte, word = found_in(trie, offsets, data)
                kept = np.array(longest(offsets[text] + byte, word, sizes), np.int64)
                text, byte, word = text[kept], byte[kept], word[kept]
                columns = [batch.column("doc").take(pa.array(text + at)), pa.array(characters(data, offsets, text, byte).astype(np.int32)), names.take(pa.array(word))]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "start", "term"])

    return source.mapInArrow(search, f"doc {source.schema['doc'].dataType.simpleString()}, start int, term string")


def marked(source: DataFrame, renderings: dict[str, str]) -> DataFrame:
    """(doc, text): texts whose matches, chosen as in spans(), are replaced by their renderings between marks; null texts are empty."""
    words = sorted(renderings)
    shipped = source.sparkSession.sparkContext.broadcast(words)
    given = source.sparkSession.sparkContext.broadcast([f"{MARK}{renderings[w]}{MARK}".encode() for w in words])

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(shipped)
        sizes = np.array([len(w.encode()) for w in trie.words], np.int64)
        for batch in batches:
            for at, offsets, data in blocks(batch.column("text")):
                text, byte, word = found_in(trie, offsets, data)
                places = offsets[text] + byte
                kept = longest(places, word, sizes)
                raw, pieces, before = data.tobytes(), [], 0
                for i in kept:
                    place, w = int(places[i]), int(word[i])
                    pieces += [raw[before:place], given.value[w]]
                    before = place + int(sizes[w])
                out = b"".join([*pieces, raw[before:]]).split(bytes([GAP]))[:-1]
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(at, len(out)), pa.array([t.decode() for t in out], pa.string())], ["doc", "text"])

    return source.mapInArrow(replace, f"doc {source.schema['doc'].dataType.simpleString()}, text string")
