"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice; lossless decoding.

A text's lattice has a node between any two characters and an edge for each piece of the vocabulary that matches. The
probability of a segmentation is proportional to the product of its pieces' weights. Forward filtering sums the
weights of all ways to each node; backward sampling draws from the end, each edge by its share, with numbers that
depend on the row's key alone. No piece reaches over the border before a space or beside a line end, so the lattice
falls into independent segments there, and a segment's forward sums are kept for its next occurrence.

The vocabulary file is of merged pairs: its scores are ranks. A piece of rank r weighs 1 / (r + 2) to the power
`sharpness` (Zipf's law for ranks). Spaces are U+2581 in pieces; a character without a piece, and U+2581 itself, is
spelled by byte pieces. Nothing is normalised, so decoding gives the text back exactly.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from quarry.llm.common import blocks, column, lean, mix64, others, read_table, small_batches

_MARK = "▁"
_SEGMENT = re.compile(r"\n| +[^ \n]*|[^ \n]+")
_NODES = 1_500_000  # lattice nodes that a task keeps
_GRAIN = float(1 << 30)  # shares are multiples of its inverse, so that they stay exact when nodes are renumbered
_BASE = np.uint64(0x9E3779B97F4A7C15)
_OTHER = 1 << 20  # codes of characters that byte pieces spell start here


class Lattices:
    """Forward-filtered lattices of segments, as flat tables: each node's edges with running shares."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = [model.id_to_piece(i) for i in normal]
        if any(_MARK in p.lstrip(_MARK) or "\n" in p for p in pieces):
            raise ValueError("pieces of this vocabulary reach over spaces or line ends")
        self.ids, self.weights = np.array(normal, np.int64), -sharpness * np.log(np.arange(len(pieces)) + 2.0)
        self.longest, self.by_size = max(map(len, pieces)), {}
        for n in {len(p) for p in pieces}:  # an open hash table for each length
            own = [k for k, p in enumerate(pieces) if len(p) == n]
            h = np.zeros(len(own), np.uint64)
            c = np.frombuffer("".join(pieces[k] for k in own).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.uint64)
            with np.errstate(over="ignore"):
                for i in range(n):
                    h = h * _BASE + c[:, i]
                h = mix64(h)
            keys, which = np.zeros(max(64, 1 << (4 * len(own)).bit_length()), np.uint64), np.zeros(max(64, 1 << (4 * len(own)).bit_length()), np.int64)
            for k, x in zip(own, h.tolist(), strict=True):
                slot = x & (len(keys) - 1)
                while keys[slot]:
                    slot = (slot + 1) & (len(keys) - 1)
                keys[slot], which[slot] = x, k
            self.by_size[n] = (keys, which)
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint32)
        if any(not model.is_byte(int(i)) for i in self.byte):
            raise ValueError("this vocabulary has no byte pieces")
        self.clear()

    def clear(self) -> None:
        self.bare, self.after = {}, {}  # number of a segment: as it stands, and with one space before
        self.share, self.piece, self.back = array("d"), array("I"), array("q")
        self.last, self.edge = array("q"), array("q", [0])  # a segment's last node, and where its edges end
        self.hits = np.zeros(0, np.int32)

    def _halve(self) -> None:
        """Keeps the half of the segments that came up most, under new numbers."""
        hits = self.hits.copy()
        known = np.zeros(len(hits), bool)
        for d in (self.bare, self.after):
            known[list(d.values())] = True
        hits[~known] = -1
        keep = np.zeros(len(hits), bool)
        keep[np.argsort(hits, kind="stable")[len(hits) - known.sum() // 2 :]] = True
        last, edge = np.array(self.last), np.array(self.edge)
        nodes, edges = np.diff(last, prepend=0), np.diff(edge)
        moved = np.cumsum(nodes * keep) - last
        own = np.repeat(keep, edges)
        move = np.repeat(moved, edges)[own]
        back = np.array(self.back)[own]
        self.share = array("d", (np.array(self.share)[own] + move).tobytes())
        self.piece = array("I", np.array(self.piece, np.uint32)[own].tobytes())
        self.back = array("q", np.where(back < 0, back, back + move).tobytes())
        self.last = array("q", np.cumsum(nodes[keep]).tobytes())
        self.edge = array("q", np.concatenate(([0], np.cumsum(edges[keep]))).tobytes())
        new = np.cumsum(keep) - 1
        self.bare, self.after = ({w: int(new[i]) for w, i in d.items() if keep[i]} for d in (self.bare, self.after))
        self.hits = self.hits[keep] // 2

    def _match(self, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes of runs of `size` characters are pieces', and the pieces' places in the vocabulary."""
        if size not in self.by_size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, which = self.by_size[size]
        h = mix64(h)
        slot = (h & np.uint64(len(keys) - 1)).astype(np.int64)
        place = np.flatnonzero(keys[slot] != 0)
        slot, h, out, at = slot[place], h[place], [], []
        while len(place):  # the next slots, as far as they are full
            hit = keys[slot] == h
            out.append(place[hit])
            at.append(which[slot[hit]])
            slot = (slot + 1) & (len(keys) - 1)
            on = ~hit & (keys[slot] != 0)
            place, slot, h = place[on], slot[on], h[on]
        return (np.concatenate(out), np.concatenate(at)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, segments: list[str]) -> None:
        """Adds the lattices of segments, numbered on from the last. A node's shares are counted from its own number."""
        if not segments:
            return
        size = np.array([len(s) for s in segments], np.int64)
        stop = np.cumsum(size)
        raw = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(raw == ord(_MARK), 0, np.where(raw == 32, ord(_MARK), raw)).astype(np.uint64)
        begin = np.repeat(stop - size, size)  # of each character's segment
        place = np.arange(len(c)) - begin
        rest = np.repeat(stop, size) - np.arange(len(c))
        to, piece, weight, wide = [], [], [], []
        h, live = np.zeros(len(c), np.uint64), np.arange(len(c))
        for n in range(1, min(self.longest, int(size.max())) + 1):
            if n > 1:  # runs that end within their segment
                fits = rest[live] >= n
                h, live = h[fits], live[fits]
            h = h * _BASE + c[live + (n - 1)]
            i, at = self._match(h, n)
            i = live[i]
            to.append(i + n - 1)
            piece.append(self.ids[at])
            weight.append(self.weights[at])
            wide.append(np.full(len(i), n))
        other = np.ones(len(c), bool)
        other[to[0]] = False
        other = np.flatnonzero(other)  # characters without a piece
        to, piece = np.concatenate([*to, other]), np.concatenate([*piece, (_OTHER + raw[other]).astype(np.int64)])
        weight, wide = np.concatenate([*weight, np.full(len(other), -12.0)]), np.concatenate([*wide, np.ones(len(other), np.int64)])
        order = np.lexsort((-wide, to))
        to, piece, weight, wide = to[order], piece[order], weight[order], wide[order]
        first = np.searchsorted(to, np.arange(len(c)))  # a node's edges
        count = np.diff(np.append(first, len(to)))
        # forward filtering, the nodes of all segments that are as far from the beginning at a time
        total, gain, steps = np.zeros(len(c)), np.zeros(len(to)), np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[steps], np.arange(int(size.max()) + 1))
        for k in range(int(size.max())):
            node = steps[bounds[k] : bounds[k + 1]]
            n = count[node]
            starts = np.cumsum(n) - n
            e = np.arange(int(n.sum())) + np.repeat(first[node] - starts, n)
            before = to[e] - wide[e]
            g = weight[e] + np.where(wide[e] == k + 1, 0.0, total[before])
            top = np.repeat(np.maximum.reduceat(g, starts), n)
            x = np.exp(g - top)
            whole = np.add.reduceat(x, starts)
            total[node] = top[starts] + np.log(whole)
            run = np.cumsum(x)
            run -= np.repeat(run[starts] - x[starts], n)
            gain[e] = run / np.repeat(whole, n)
        base = self.last[-1] if self.last else 0
        share = np.floor(np.minimum(gain, 1.0) * _GRAIN) / _GRAIN
        share[np.append(first[1:], len(to)) - 1] = 1.0
        self.share.frombytes((share + to + base + 1).tobytes())
        self.piece.frombytes(piece.astype(np.uint32).tobytes())
        back = to - wide
        self.back.frombytes(np.where(back < begin[to], -1, back + base + 1).astype(np.int64).tobytes())
        self.last.frombytes((stop + base).astype(np.int64).tobytes())
        self.edge.frombytes((np.append(first, len(to))[stop] + self.edge[-1]).astype(np.int64).tobytes())

    def _number(self, new: dict[tuple[bool, str], int]) -> None:
        """Adds the new segments, in the order of their numbers."""
        self.add([" " + s if after else s for after, s in new])
        for (after, s), i in new.items():
            if len(s) < 200:
                (self.after if after else self.bare)[s] = i

    def numbers(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """The numbers of the segments of all texts, and how many each text has."""
        out, counts, new, held = [], [], {}, len(self.last)

        def number(known: dict, after: bool, s: str) -> int:
            if (i := known.get(s)) is None and (i := new.get((after, s))) is None:
                i = new[(after, s)] = held + len(new)
            return i

        for text in texts:
            n = len(out)
            for k, line in enumerate((text or "").split("\n")):
                if k:
                    out.append(number(self.bare, False, "\n"))
                if "  " in line or line.endswith(" "):
                    out += [number(self.bare, False, s) for s in _SEGMENT.findall(line)]
                elif line:
                    words = line.split(" ")
                    if words[0]:
                        out.append(number(self.bare, False, words[0]))
                    after = self.after
                    out += [i if (i := after.get(w)) is not None else number(after, True, w) for w in words[1:]]
            counts.append(len(out) - n)
        self._number(new)
        return out, counts

    def sample(self, keys: list[int], texts: list[str | None], seed: int) -> list[np.ndarray]:
        """The sampled ids of each text."""
        if self.last and self.last[-1] > _NODES:
            self._halve()
        own, counts = (np.array(x, np.int64) for x in self.numbers(texts))
        if not len(own):
            return [np.zeros(0, np.uint32)] * len(texts)
        hits = np.bincount(own, minlength=len(self.last))
        hits[: len(self.hits)] += self.hits
        self.hits = hits.astype(np.int32)
        node = np.array(self.last)[own]
        with np.errstate(over="ignore"):
            row = mix64(np.array([k & 0xFFFFFFFFFFFFFFFF for k in keys], np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
            within = np.arange(len(node)) - np.repeat(np.cumsum(counts) - counts, counts)
            salt = mix64(np.repeat(row, counts) ^ (within.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        share, piece, back = np.frombuffer(self.share), np.frombuffer(self.piece, np.uint32), np.frombuffer(self.back, np.int64)
        live, steps, step = np.arange(len(node)), [], 0
        while len(live):
            u = (mix64(salt[live] + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = np.searchsorted(share, node[live] + u, side="right")
            steps.append((live, piece[edge]))
            node[live] = back[edge]
            live, step = live[node[live] >= 0], step + 1
        size = np.bincount(np.concatenate([x for x, _ in steps]), minlength=len(node))
        last = np.cumsum(size) - 1
        out = np.zeros(int(size.sum()), np.uint32)
        for k, (x, ids) in enumerate(steps):
            out[last[x] - k] = ids
        del share, piece, back
        bounds = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
        return [self._spelled(out[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _spelled(self, ids: np.ndarray) -> np.ndarray:
        """The ids with characters that have no piece spelled by byte pieces."""
        if not len(other := np.flatnonzero(ids >= _OTHER)):
            return ids
        spelled = [self.byte[list(chr(c).encode("utf-8", "surrogatepass"))] for c in (ids[other] - _OTHER).tolist()]
        sizes = np.ones(len(ids), np.int64)
        sizes[other] = [len(x) for x in spelled]
        out, at = np.repeat(ids, sizes), np.cumsum(sizes) - sizes
        for i, x in zip(other.tolist(), spelled, strict=True):
            out[at[i] : at[i] + len(x)] = x
        return out


class Pieces:
    """Bytes of each piece, for decoding."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        raw = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else model.id_to_piece(i).replace(_MARK, " ").encode() for i in range(model.get_piece_size())]
        self.size = np.array([len(x) for x in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        size = self.size[ids]
        before = np.cumsum(size) - size
        return self.flat[np.arange(int(size.sum())) + np.repeat(self.start[ids] - before, size)].tobytes().decode("utf-8", "surrogatepass")


def encode_sampled(spark: SparkSession, docs: DataFrame, model: str, key: str = "doc_id", seed: int = 1, sharpness: float = 1.0) -> DataFrame:
    """Adds `ids`, the binary of a text's sampled ids (little-endian unsigned 32-bit), to documents (key, text, ...).

    The draw depends on the row's key, the seed and the text, not on partitions or order. Null and empty texts have no
    ids. A null key draws as key 0; rows with the same key and text draw alike. A text of any length is encoded whole; a
    task holds the lattices of the texts that come together, a hundred of them and a million characters at most, or one
    longer text's. No rows give no rows. A column `ids` is replaced; all others stay, whatever their names.
    """
    small_batches(spark, 250)
    other = others(docs, "ids")
    rest = [f"c{i}" if c != "text" else "text" for i, c in enumerate(other)]
    kept = docs.select(*(column(c).alias(n) for c, n in zip(other, rest, strict=True)))
    schema = StructType([*kept.schema.fields, StructField("ids", BinaryType())])

    def part(batches):
        import pyarrow as pa

        lattices = Lattices(model, sharpness)
        for b in batches:
            columns = [b.column(b.schema.get_field_index(c)) for c in rest]
            keys = [k or 0 for k in b.column(b.schema.get_field_index("key")).to_pylist()]
            texts, ids = b.column(b.schema.get_field_index("text")).to_pylist(), []
            for s in blocks([len(t or "") for t in texts], count=100):
                ids += [x.astype("<u4").tobytes() for x in lattices.sample(keys[s], texts[s], seed)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], names=schema.names)

    keyed = docs.select(*(column(c).alias(n) for c, n in zip(other, rest, strict=True)), column(key).cast("long").alias("key"))
    return keyed.mapInArrow(lean(part), schema).toDF(*other, "ids")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Adds `decoded`, the text of `ids`; no ids (null or empty) give an empty text. A column `decoded` is replaced."""
    other = others(encoded, "decoded")
    rest = [f"c{i}" if c != "ids" else "ids" for i, c in enumerate(other)]
    kept = encoded.select(*(column(c).alias(n) for c, n in zip(other, rest, strict=True)))
    schema = StructType([*kept.schema.fields, StructField("decoded", StringType())])

    def part(batches):
        import pyarrow as pa

        pieces = Pieces(model)
        for b in batches:
            texts = [pieces.decode(np.frombuffer(x or b"", "<u4")) for x in b.column(b.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), pa.array(texts, pa.string())], names=schema.names)

    return kept.mapInArrow(lean(part), schema).toDF(*other, "decoded")


def piece_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids_crc32 and whether decoding gave the text back, of every row of documents.

    Null and empty texts have no pieces and are lossless; a null doc_id stays null and draws as 0; repeated rows come
    back as often, with the same draw; no documents give no rows. Other columns aren't read.
    """
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    out = decode(encode_sampled(spark, docs.select("doc_id", "text"), model), model)
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", F.length(text).cast("long").alias("n_chars"), F.expr("cast(length(ids) div 4 as long)").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"), (F.col("decoded") == text).alias("lossless"),
    )


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentation of every document, and its decoding."""
    return piece_digests(spark, read_table(spark, sf_dir, "documents"))
