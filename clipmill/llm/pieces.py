"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text, with blanks written as the piece mark and one mark put in front, is cut
where no piece of the model can cross. For each distinct chunk the forward
probabilities of its lattice of pieces are computed once and kept in flat arrays:
for every place, the cumulative probabilities of the pieces that end there, the
longest first. A sample walks back from the end of a chunk; all chunks of a batch
of texts take a step at once. The random numbers come from the row's key,
the chunk's place and the step, so a rerun gives the same pieces.

Characters the model has no piece for become its byte pieces, and so does a piece
mark that stands in the text itself; decoding is therefore always exact.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LITERAL = "\ud800"  # stands for a piece mark of the text itself; no valid text holds a lone surrogate
BATCH, ROWS = 1 << 18, 512
MOST_STATES = 500_000  # places whose tables are kept; a worker holds them while it lives
SCALAR, CELLS = 64, 100_000  # characters of one chunk, and of all, that go through the lattice side by side
FEW = 8  # of a batch's new chunks, those longer than all but so many go one by one
GOLD = np.uint64(0x9E3779B97F4A7C15)
RESULT = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType()), T.StructField("lossless", T.BooleanType())])


def mixed(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit hash of each counter."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Growing:
    """An array that grows by doubling."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1024, kind), 0

    def extend(self, values: list | np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(len(self.data), len(values)), self.data.dtype)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def view(self) -> np.ndarray:
        return self.data[: self.n]


class Lattices:
    """A model's pieces with weights, and the forward tables of the chunks met so far."""

    def __init__(self, model: bytes, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = len(sp)
        names = [sp.id_to_piece(i) for i in range(self.size)]
        scores = [sp.get_score(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte = {int(names[i][3:5], 16): i for i in range(self.size) if sp.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte pieces; decoding would not be lossless")
        # Scores of a BPE model are ranks of merges: read as Zipf's law. Those of a unigram model are log probabilities.
        ranks = all(scores[i] == int(scores[i]) for i in plain)
        weigh = (lambda s: -math.log(2.0 + min(-s, self.size))) if ranks else (lambda s: s)
        self.weight = {names[i]: (i, alpha * weigh(scores[i])) for i in plain}
        self.rare = alpha * min([weigh(-float(self.size)) if ranks else min(scores), -1.0])
        self.longest = max(map(len, self.weight))
        joined = {c for p in self.weight if len(p) > 1 for c in p}
        crossing = any(MARK in p.lstrip(MARK) for p in self.weight)
        alone = "" if "\n" in joined else "\n"
        self.cut = re.compile(r"(?s:.+)" if crossing else rf"{MARK}*+[^{MARK}{alone}]++|{MARK}++" + (rf"|\n" if alone else ""))
        self.bytes_of = [b""] * self.size
        for i in plain:
            self.bytes_of[i] = names[i].replace(MARK, " ").encode()
        for value, i in self.byte.items():
            self.bytes_of[i] = bytes([value])
        self.rows, self.row_of = [], {}  # byte pieces of characters without a piece of their own
        self.build_trie()
        self.clear()

    def build_trie(self) -> None:
        """The pieces as a hash table of (node, character) with the node each leads to."""
        step: dict[tuple[int, str], int] = {}
        at_node = {}
        for name, found in self.weight.items():
            node = 0
            for c in name:
                node = step.setdefault((node, c), len(step) + 1)
            at_node[node] = found
        keys, after = np.array([(n << 21) + ord(c) for n, c in step], np.int64), np.array(list(step.values()), np.int64)
        self.first = np.zeros(0x110000, np.int64)  # by first character; 0 where no piece begins so
        self.first[keys[keys < 1 << 21]] = after[keys < 1 << 21]
        bits = 2 + len(keys).bit_length()
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys, self.next = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        at, left = self.slot(keys), np.arange(len(keys))
        while len(left):  # a key whose slot is taken goes to the next
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask
        self.next[at] = after
        self.node_piece = np.full(len(step) + 1, -1, np.int32)
        self.node_weight = np.full(len(step) + 1, -np.inf)
        for node, (piece, weight) in at_node.items():
            self.node_piece[node], self.node_weight[node] = piece, weight

    def child(self, node: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The node that a character leads to from each node, 0 where there is none."""
        key = (node << 21) + chars
        at = self.slot(key)
        there = self.keys[at]
        out = np.where(there == key, self.next[at], 0)
        on = np.flatnonzero((there != key) & (there >= 0))  # the slot is another key's: the next ones may hold it
        while len(on):
            at[on] = (at[on] + 1) & self.mask
            there = self.keys[at[on]]
            hit = there == key[on]
            out[on[hit]] = self.next[at[on[hit]]]
            on = on[~hit & (there >= 0)]
        return out

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * GOLD) >> self.shift).astype(np.int64)

    def clear(self) -> None:
        self.end: dict[str, int] = {}
        self.states = 0
        self.start, self.upto, self.before, self.piece = Growing(np.int32), Growing(np.float32), Growing(np.int32), Growing(np.int32)

    def fallback(self, c: str) -> int:
        """Code, from ``size`` on, of the row of byte pieces that spell a character."""
        if c not in self.row_of:
            self.row_of[c] = len(self.rows)
            self.rows.append([self.byte[b] for b in (MARK if c == LITERAL else c).encode("utf-8", "surrogatepass")])
        return self.size + self.row_of[c]

    def add(self, chunk: str) -> int:
        """The state at the end of a chunk. States are places 1 to n; place 0 is -1."""
        n, weight, longest = len(chunk), self.weight, self.longest
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, min(n, i + longest) + 1):
                found = weight.get(chunk[i:j])
                if found:
                    into[j].append((i, *found))
            if chunk[i] not in weight:
                code = self.fallback(chunk[i])
                into[i + 1].append((i, code, self.rare * len(self.rows[code - self.size])))
        first = self.states - 1  # of place 0, which has no state
        ahead = [0.0]
        start, upto, before, piece = [], [], [], []
        for j in range(1, n + 1):
            start.append(self.upto.n + len(upto))
            terms = [ahead[i] + w for i, _, w in into[j]]
            top = max(terms)
            parts = [math.exp(t - top) for t in terms]
            total = sum(parts)
            ahead.append(top + math.log(total))
            run = 0.0
            for (i, code, _), p in zip(into[j], parts, strict=True):
                run += p
                upto.append(run / total)
                before.append(first + i if i else -1)
                piece.append(code)
            upto[-1] = 1.0
        self.states += n
        self.start.extend(start)
        self.upto.extend(upto)
        self.before.extend(before)
        self.piece.extend(piece)
        self.end[chunk] = first + n
        return first + n

    def add_all(self, chunks: set[str]) -> None:
        """Forward tables of new chunks; all but the longest go through the lattice side by side."""
        ordered = sorted(chunks, key=len, reverse=True)
        most = min(SCALAR, len(ordered[FEW])) if len(ordered) > FEW else 0
        at = 0
        while at < len(ordered) and len(ordered[at]) > most:
            self.add(ordered[at])
            at += 1
        while at < len(ordered):
            to = at + 1 + CELLS // len(ordered[at])
            self.add_side_by_side(ordered[at:to])
            at = to

    def add_side_by_side(self, chunks: list[str]) -> None:
        """As ``add``, for chunks from long to short.

        At each place stand the characters of the chunks that reach it, so a cell is
        ``base[place] + row``; the state of a cell's end is ``first`` more.
        """
        rows, size = len(chunks), np.array([len(c) for c in chunks], np.int64)
        n, first = int(size[0]), self.states
        deep = min(n, self.longest)
        reach = np.searchsorted(-size, -np.arange(n + deep))  # chunks with a character at each place
        base = (np.cumsum(reach) - reach)
        cells = int(base[n])
        place = np.repeat(np.arange(n), reach[:n])
        row = np.arange(cells) - base[place]
        chars = np.empty(cells, np.int64)
        along = np.arange(cells) - np.repeat(np.cumsum(size) - size, size)
        chars[base[along] + np.repeat(np.arange(rows), size)] = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        node = self.first[chars]
        weight, piece = self.node_weight[node], self.node_piece[node]
        for cell in np.flatnonzero(piece < 0).tolist():
            code = self.fallback(chr(chars[cell]))
            weight[cell], piece[cell] = self.rare * len(self.rows[code - self.size]), code
        found = [(row, place, weight, piece)]  # pieces of each length, by place and row; of one character there is one in each cell
        some = np.flatnonzero(node)
        row, place, node = row[some], place[some], node[some]
        for k in range(1, deep):
            inside = np.flatnonzero(row < reach[place + k])
            row, place, node = row[inside], place[inside], node[inside]
            node = self.child(node, chars[base[place + k] + row])
            some = np.flatnonzero(node)
            row, place, node = row[some], place[some], node[some]
            some = np.flatnonzero(self.node_piece[node] >= 0)
            found.append((row[some], place[some], self.node_weight[node[some]], self.node_piece[node[some]]))
        bounds = [np.searchsorted(f[1], np.arange(n + 1)).tolist() for f in found]
        sums, nth = [np.empty(len(f[0])) for f in found], [np.empty(len(f[0]), np.int64) for f in found]
        ahead, total, count = np.zeros((n + 1, rows)), np.empty(cells), np.empty(cells, np.int64)
        for j in range(1, n + 1):
            here = int(reach[j - 1])
            top, run, times, terms = np.full(here, -np.inf), np.zeros(here), np.zeros(here, np.int64), []
            for k in range(min(j, deep) - 1, -1, -1):
                a, b = bounds[k][j - 1 - k : j - k + 1]
                if a < b:
                    r = found[k][0][a:b]
                    term = ahead[j - 1 - k][r] + found[k][2][a:b]
                    top[r] = np.maximum(top[r], term)
                    terms.append((k, a, b, r, term))
            for k, a, b, r, term in terms:
                sums[k][a:b] = upto = run[r] + np.exp(term - top[r])
                run[r] = upto
                nth[k][a:b] = times[r]
                times[r] += 1
            ahead[j, :here] = top + np.log(run)
            at = int(base[j - 1])
            total[at : at + here], count[at : at + here] = run, times
        start = np.cumsum(count) - count
        edges = int(start[-1] + count[-1])
        upto, before, code = np.empty(edges, np.float32), np.empty(edges, np.int32), np.empty(edges, np.int32)
        for k, (row, place, _, piece) in enumerate(found):
            end = base[place + k] + row
            at = start[end] + nth[k]
            upto[at] = sums[k] / total[end]
            before[at] = np.where(place > 0, first + base[place - 1] + row, -1)
            code[at] = piece
        self.start.extend(self.upto.n + start)
        self.upto.extend(upto)
        self.before.extend(before)
        self.piece.extend(code)
        self.states += cells
        self.end.update(zip(chunks, (first + base[size - 1] + np.arange(rows)).tolist(), strict=True))

    def escape(self, text: str) -> str:
        """The text as the lattice reads it."""
        if MARK in text:
            text = text.replace(MARK, LITERAL)
        return MARK + text.replace(" ", MARK)

    def sample(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text) of one segmentation per text."""
        chunks = [self.cut.findall(self.escape(t)) if t else [] for t in texts]
        counts = np.array([len(c) for c in chunks], np.int64)
        end = self.end
        flat = list(chain.from_iterable(chunks))
        self.add_all(set(flat).difference(end))
        state = np.fromiter(map(end.__getitem__, flat), np.int64, len(flat))
        place = np.arange(len(state)) - np.repeat(np.cumsum(counts) - counts, counts)
        key = mixed(np.repeat(seeds, counts) + place.astype(np.uint64) * GOLD)
        start, upto, before, piece = self.start.view, self.upto.view, self.before.view, self.piece.view
        extra = np.array([len(r) for r in self.rows] or [1], np.int64)
        active, steps, length = np.arange(len(state)), [], np.zeros(len(state), np.int64)
        step = 0
        while len(active):
            step += 1
            u = (mixed(key[active] + np.uint64(step * int(GOLD) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = start[state[active]]
            u = u.astype(np.float32)
            later = np.flatnonzero(upto[edge] <= u)
            while len(later):  # u may round to 1, which no sum is above: the last piece then
                later = later[upto[edge[later]] < 1]
                edge[later] += 1
                later = later[upto[edge[later]] <= u[later]]
            code = piece[edge]
            size = np.where(code < self.size, 1, extra[np.maximum(code - self.size, 0)])
            length[active] += size
            steps.append((active, code, size))
            back = before[edge]
            more = back >= 0
            state[active] = back
            active = active[more]
        stop = np.cumsum(length)
        out = np.zeros(int(stop[-1]) if len(stop) else 0, np.int32)
        rows = np.array([r + [0] * (4 - len(r)) for r in self.rows] or [[0] * 4], np.int32)
        for active, code, size in steps:
            stop[active] -= size
            to = stop[active]
            one = code < self.size
            out[to[one]] = code[one]
            if not one.all():
                to, row, size = to[~one], code[~one] - self.size, size[~one]
                for k in range(4):
                    has = size > k
                    out[to[has] + k] = rows[row[has], k]
        text_of = np.repeat(np.arange(len(texts)), counts)
        return out, np.bincount(text_of, length, len(texts)).astype(np.int64)

    def encode(self, texts: list[str | None], keys: list) -> tuple[np.ndarray, np.ndarray]:
        seeds = np.array([xxhash.xxh64_intdigest(str(k)) for k in keys], np.uint64)
        ids, counts, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while at < len(texts):
            to, size = at + 1, len(texts[at] or "")
            while to < len(texts) and size + len(texts[to] or "") < BATCH:
                size += len(texts[to] or "")
                to += 1
            if self.states > MOST_STATES:
                self.clear()
            a, b = self.sample([t or "" for t in texts[at:to]], seeds[at:to])
            ids.append(a)
            counts.append(b)
            at = to
        return np.concatenate(ids), np.concatenate(counts)

    def decode(self, ids: list[int]) -> str:
        raw = b"".join([self.bytes_of[i] for i in ids])
        return raw[1:].decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def lattices(model: bytes, alpha: float) -> Lattices:
    """One per worker and model."""
    return Lattices(model, alpha)


def load(path: str = MODEL) -> bytes:
    """The model's bytes, read on the driver; tasks get them with their code and need no file."""
    with open(path, "rb") as f:
        return f.read()


def as_lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """All rows as struct ``row`` with ``ids``, a sampled segmentation; the row's id and ``seed`` fix it.

    Null and empty texts have no pieces; rows that repeat id and text have the same
    pieces. ``alpha`` sharpens (above 1) or flattens (below 1) the distribution.
    """
    proto = load(model)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(keys: pa.Array, texts: pa.Array) -> pa.Array:
        give_back()
        return as_lists(*lattices(proto, alpha).encode(texts.to_pylist(), [f"{seed}:{k}" for k in keys.to_pylist()]))

    return df.select(F.struct("*").alias("row"), ids(F.col(id_col), F.col(text_col)).alias("ids"))


def decode(df: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """All rows as struct ``row`` with ``text``; the exact text that was encoded (null counts as empty)."""
    proto = load(model)

    @F.arrow_udf(T.StringType())
    def texts(ids: pa.Array) -> pa.Array:
        table = lattices(proto, 1.0)
        return pa.array([table.decode(x or []) for x in ids.to_pylist()], pa.string())

    return df.select(F.struct("*").alias("row"), texts(F.col(ids_col)).alias("text"))


def checked(table: Lattices, keys: pa.Array, texts: pa.Array, seed: int) -> pa.Array:
    """A batch's ids, with digests of what they decode to."""
    all_ids, all_counts, hashes, same = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [], []
    for start in range(0, len(texts), ROWS):  # few rows at a time, so that memory stays low
        plain = texts.slice(start, ROWS).to_pylist()
        ids, counts = table.encode(plain, [f"{seed}:{k}" for k in keys.slice(start, ROWS).to_pylist()])
        at = 0
        for text, n in zip(plain, counts.tolist(), strict=True):
            back = table.decode(ids[at : at + n].tolist())
            hashes.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
            same.append(back == (text or ""))
            at += n
        all_ids.append(ids)
        all_counts.append(counts)
    lists = as_lists(np.concatenate(all_ids), np.concatenate(all_counts))
    return pa.StructArray.from_arrays([lists, pa.array(hashes, pa.string()), pa.array(same, pa.bool_())], ["ids", "decoded_sha256", "lossless"])


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """All rows as struct ``row`` with ids, n_pieces, decoded_sha256 and lossless; both ways in one pass."""
    proto = load(model)

    @F.arrow_udf(RESULT)
    def both(keys: pa.Array, texts: pa.Array) -> pa.Array:
        give_back()
        return checked(lattices(proto, alpha), keys, texts, seed)

    packed = df.select(F.struct("*").alias("row"), both(F.col(id_col), F.col(text_col)).alias("r"))
    return packed.select("row", "r.ids", F.size("r.ids").cast("long").alias("n_pieces"), "r.decoded_sha256", "r.lossless")
