"""SentencePiece encoding and decoding: distinct sampled segmentations of a text.

All segmentations of a text form a lattice of vocabulary pieces; a path has the
product of its pieces' weights as probability.  Drawing ``k`` distinct paths is
Gumbel top-k: each path gets its log-probability plus Gumbel noise and the ``k``
largest are taken.  An A-star search finds them without listing paths.  Its agenda
holds sets of paths (a common prefix, then anything but the pieces already
drawn); the exact bound of a set is its largest perturbed value, which is
Gumbel-distributed around the set's log-mass and cut off at the value of the
set it was split from.  The popped set yields one path by ancestral sampling
and is split along it.  The next bound left over is the threshold ``kappa`` of
the inclusion score ``log(1 - exp(-exp(log_prob - kappa)))``.

Pieces never cross the start of a word, nor the place where certain signs follow
a letter (no piece of the vocabulary has both), so the lattice is a chain of
units, and the log-mass of a set is a sum over units.  Lattices of distinct units are kept in flat arrays; all texts of a
slice walk through them together.  Random numbers are hashes of seed, row key, path,
unit and step: a row gets the same segmentations wherever and however often
it is computed.

The vocabulary is a merge list without probabilities, so a piece of rank ``r``
weighs ``(r + 1) ** -alpha``; a character outside the vocabulary is its bytes, with the
weight of the last rank.  Null counts as the empty text, whose only segmentation
is empty, with log-probability 0 and inclusion 0.  Texts with fewer than ``k``
segmentations give all they have.  Rows with equal key and text get equal rows;
a null key counts as -1, so the key is an integer column.  Decoding gives the text back, but for the mark U+2581
itself, which comes back as a space.
"""

from __future__ import annotations

import math
import re
import string
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import ship_package, slices, texts_of

MARK = "▁"
#: Units kept in a worker; when more are known the tables start anew.
KEPT_UNITS = 200_000


_GOLDEN, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit integers (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on keys and salt alone."""
    return ((_mixed(keys + np.uint64(salt * _GOLDEN & _ALL)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def _one_uniform(key: int, salt: int) -> float:
    """``_uniform`` of one key, without arrays."""
    x = (key + salt * _GOLDEN) & _ALL
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _ALL
    return (((x ^ (x >> 31)) >> 11) + 0.5) / (1 << 53)


#: Salts of what is drawn for a key; up to the first, steps of a walk.
_TOP, _SPLIT, _AGAIN, _OTHER = 1 << 40, (1 << 40) + 1, (1 << 40) + 2, 1 << 41


class _Grown:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self._all, self.size = np.zeros(1024, dtype=dtype), 0

    def add(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self._all):
            self._all = np.concatenate([self._all[:self.size], np.zeros(self.size // 4 + len(values), dtype=self._all.dtype)])
        self._all[self.size:self.size + len(values)] = values
        self.size += len(values)

    @property
    def values(self) -> np.ndarray:
        return self._all[:self.size]


def _unit_pattern(pieces: list[str]) -> re.Pattern:
    """Cuts text where no piece can go across: before marks, and between a letter and signs that follow none in any piece."""
    other = "".join({c for p in pieces for c in p if re.match(r"[^\W\d_]", c) and not c.isalpha()})
    letter = rf"[^\W\d_{re.escape(other)}]"
    behind = {b for p in pieces for a, b in zip(p, p[1:]) if re.match(letter, a)}
    if not (of := re.escape("".join(c for c in string.punctuation if c not in behind))):
        return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
    return re.compile(rf"(?:{MARK}+|[{of}]|[^{MARK}{of}])(?:[^{MARK}{of}]+|(?<!{letter})[{of}])*")


class Lattices:
    """Lattices of units in flat arrays: nodes with their outgoing edges, the likeliest first."""

    def __init__(self, model: str, alpha: float):
        import sentencepiece

        vocabulary = sentencepiece.SentencePieceProcessor(model_file=model)
        size = vocabulary.get_piece_size()
        self.bytes = {}
        self._single = np.full(sys.maxunicode + 1, -1, dtype=np.int64)
        self._words = ahocorasick.Automaton()
        self._weight, self._length = np.zeros(size), np.zeros(size, dtype=np.int64)
        for k in range(size):
            piece = vocabulary.id_to_piece(k)
            if vocabulary.is_byte(k):
                self.bytes[int(piece[3:5], 16)] = k
            elif not (vocabulary.is_control(k) or vocabulary.is_unknown(k) or vocabulary.is_unused(k)):
                self._weight[k] = -alpha * np.log(min(max(0.0, -vocabulary.get_score(k)), size - 1) + 1)
                self._length[k] = len(piece)
                if len(piece) == 1:
                    self._single[ord(piece)] = k
                else:
                    self._words.add_word(piece, k)
        self._words.make_automaton()
        self.units = _unit_pattern([vocabulary.id_to_piece(k) for k in range(size)])
        self._last = -alpha * np.log(size)
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        # of units: nodes of start and end; of nodes: the first edge
        self.node, self.end, self.first = _Grown(np.int32), _Grown(np.int32), _Grown(np.int32)
        # of edges: node, piece (below 0: a character as bytes, -1 - code point), log-probability, cumulated probability
        self.target, self.piece, self.log_p, self.cum = _Grown(np.int32), _Grown(np.int32), _Grown(np.float64), _Grown(np.float32)

    def look_up(self, texts: list[list[str]], n: int) -> np.ndarray:
        new = list(set(chain.from_iterable(texts)).difference(self.ids))
        if new and len(self.ids) + len(new) > KEPT_UNITS:
            self.clear()
            new = list(set(chain.from_iterable(texts)))
        if new:
            self._add(new)
        return np.fromiter(map(self.ids.__getitem__, chain.from_iterable(texts)), dtype=np.int32, count=n)

    def _edges(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start and end position, piece and weight of all edges; a unit has a position more than characters."""
        joined = "\0".join(units)
        found = np.fromiter(chain.from_iterable(self._words.iter(joined)), dtype=np.int64).reshape(-1, 2)
        end, piece = found[:, 0] + 1, found[:, 1]
        # and every character by itself, as a piece or as bytes
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        inside = np.ones(len(joined), dtype=bool)
        inside[np.cumsum(np.fromiter(map(len, units), dtype=np.int64, count=len(units)) + 1)[:-1] - 1] = False
        at = np.flatnonzero(inside)
        codes = codes[at]
        single = self._single[codes]
        n_bytes = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        alone = np.where(single >= 0, single, -1 - codes)
        weight = np.where(single >= 0, self._weight[single], self._last * n_bytes)
        return np.r_[end - self._length[piece], at], np.r_[end, at + 1], np.r_[piece, alone], np.r_[self._weight[piece], weight]

    def _add(self, units: list[str]) -> None:
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        base = np.cumsum(lengths + 1) - lengths - 1
        start, target, piece, weight = self._edges(units)
        # log-mass of all paths from a node to the end of its unit, from the last position to the first
        n_nodes = int(lengths.sum() + len(units))
        mass = np.full(n_nodes, -np.inf)
        mass[base + lengths] = 0
        left = np.repeat(lengths, lengths + 1) - (np.arange(n_nodes) - np.repeat(base, lengths + 1))
        order = np.argsort(left[start] * n_nodes + start, kind="stable")  # the same whatever else is in the slice
        start, target, piece, weight = start[order], target[order], piece[order], weight[order]
        bounds = np.searchsorted(left[start], np.arange(1, lengths.max() + 2))
        for lo, hi in zip(bounds.tolist(), bounds[1:].tolist()):
            if hi > lo:
                value, of = weight[lo:hi] + mass[target[lo:hi]], start[lo:hi]
                heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                top = np.maximum.reduceat(value, heads)
                mass[of[heads]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, np.diff(np.r_[heads, len(of)]))), heads))
        log_p = weight + mass[target] - mass[start]
        p = np.exp(log_p)
        order = np.argsort(start - 0.999 * np.minimum(p, 1.0), kind="stable")  # the likeliest edge of a node first
        start, target, piece, log_p, p = start[order], target[order], piece[order], log_p[order], p[order]
        # sums inside each node only, so that no number depends on what else is in the slice
        cum, first = p.copy(), np.searchsorted(start, np.arange(n_nodes))
        rank = np.arange(len(start)) - first[start]
        for r in range(1, int(rank.max()) + 1):
            at = np.flatnonzero(rank == r)
            cum[at] += cum[at - 1]
        last = np.r_[start[1:] != start[:-1], True]
        cum[last] = 2.0  # the last edge takes what rounding leaves
        log_p[last & np.r_[True, start[1:] != start[:-1]]] = 0.0  # and an only edge is certain
        nodes, edges, known = self.first.size, self.target.size, len(self.ids)
        self.ids.update(zip(units, range(known, known + len(units))))
        self.node.add(base + nodes)
        self.end.add(base + lengths + nodes)
        self.first.add(first + edges)
        self.target.add(target + nodes)
        self.piece.add(piece)
        self.log_p.add(log_p)
        self.cum.add(cum)

    def walk(self, units: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ancestral samples: edges of each unit in order, flat, and how many each has."""
        first, target, cum = self.first.values, self.target.values, self.cum.values
        at, end = self.node.values[units], self.end.values[units]
        active, steps, counts = np.arange(len(units), dtype=np.int32), [], np.zeros(len(units), dtype=np.int64)
        while len(active):
            u = _uniform(keys, len(steps)).astype(np.float32)
            edge = first[at]
            wrong = np.flatnonzero(cum[edge] < u)
            while len(wrong):
                edge[wrong] += 1
                wrong = wrong[cum[edge[wrong]] < u[wrong]]
            steps.append((active, edge))
            counts[active] += 1
            at = target[edge]
            going = at != end
            active, at, end, keys = active[going], at[going], end[going], keys[going]
        starts = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), dtype=np.int32)
        for k, (active, edge) in enumerate(steps):
            flat[starts[active] + k] = edge
        return flat, counts

    def other_walk(self, unit: int, drawn: list[list[int]], key: int) -> list[int]:
        """One path through a unit that is none of those drawn before."""
        first_of, target, cum, log_p = self.first.values, self.target.values, self.cum.values, self.log_p.values
        at, end, edges, same = int(self.node.values[unit]), int(self.end.values[unit]), [], drawn
        while at != end:
            stop = first = int(first_of[at])
            p = []
            while not p or cum[stop - 1] < 1.5:
                p.append(math.exp(log_p[stop]))
                stop += 1
            for path in same:  # what the drawn paths take of an edge's mass
                p[path[len(edges)] - first] -= math.exp(sum(log_p[e] for e in path[len(edges):]))
            p = [max(x, 0.0) if x > 1e-15 else 0.0 for x in p]
            u = _one_uniform(key, _OTHER + len(edges)) * sum(p)
            pick, total = None, 0.0
            for k, x in enumerate(p):
                total += x
                if x > 0:
                    pick = k
                    if total > u:
                        break
            if pick is None:  # all mass is lost to rounding: any edge that no drawn path ends with
                pick = next(k for k in range(len(p)) if not any(q[len(edges)] == first + k and len(q) == len(edges) + 1 for q in same))
            same = [q for q in same if q[len(edges)] == first + pick]
            edges.append(first + pick)
            at = int(target[first + pick])
        return edges


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive ranges, none of them empty."""
    return np.add.reduceat(values, np.cumsum(counts) - counts) if len(counts) else np.zeros(0)


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of consecutive ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _cut_gumbel(location: np.ndarray, limit: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values around ``location`` given that they stay below ``limit``."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        out = location - np.log(np.exp(np.clip(location - limit, -700, 700)) - np.log(u))
    return np.where(np.isfinite(location), np.minimum(out, limit), -np.inf)


def _rest(log_p: np.ndarray) -> np.ndarray:
    """log(1 - p)."""
    with np.errstate(divide="ignore"):
        return np.log(-np.expm1(np.minimum(log_p, 0)))


class _Path:
    """One sampled path of every text of a slice; arrays hold a value for each unit."""

    def __init__(self, start: np.ndarray, counts: np.ndarray, log_p: np.ndarray, heads: np.ndarray, sizes: np.ndarray):
        self.start, self.counts, self.log_p = start, counts, log_p
        self.prefix, self.total = np.zeros(len(log_p)), np.zeros(len(heads))
        for i in np.flatnonzero(sizes).tolist():
            lo, hi = heads[i], heads[i] + sizes[i]
            sums = np.cumsum(log_p[lo:hi])
            self.prefix[lo + 1:hi], self.total[i] = sums[:-1], sums[-1]
        self.bound: np.ndarray | None = None  # of the set split off at each unit


@dataclass(frozen=True)
class _Drawn:
    """The same path (the first, second, ...) of all texts that have it.

    Pieces stand flat, of text ``i`` from ``first[i]`` to ``end[i]``; characters
    outside the vocabulary are -1 - their code point.
    """

    texts: np.ndarray
    pieces: np.ndarray
    first: np.ndarray
    end: np.ndarray
    log_prob: np.ndarray
    log_inclusion: np.ndarray


class Sampler:
    def __init__(self, model: str, alpha: float, k: int, seed: int):
        self.lattices, self.k, self.seed = Lattices(model, alpha), k, seed

    def draw(self, keys: list[int], texts: list[str]) -> list[_Drawn]:
        """The paths of all texts, the largest perturbed values first."""
        units = [self.lattices.units.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        lattices = self.lattices
        ids = lattices.look_up(units, int(sizes.sum()))
        del units
        heads = np.cumsum(sizes) - sizes
        rows = _mixed(np.array(keys, dtype=np.int64).astype(np.uint64) + np.uint64(self.seed * _GOLDEN & _ALL))
        ordinal = (np.arange(len(ids)) - np.repeat(heads, sizes)).astype(np.uint64)
        unit_keys = _mixed(np.repeat(rows, sizes) + ordinal)
        flat, counts = lattices.walk(ids, unit_keys)
        pools, pooled = [flat], len(flat)
        path = _Path(np.cumsum(counts) - counts, counts, _sums(lattices.log_p.values[flat], counts), heads, sizes)
        top = -np.log(-np.log(_uniform(rows, _TOP)))
        path.bound = _cut_gumbel(path.prefix + _rest(path.log_p), np.repeat(top, sizes), _uniform(unit_keys, _SPLIT))
        paths, there = [path], [np.ones(len(texts), dtype=bool)]
        drawn: dict[tuple[int, int, int], list[list[int]]] = {}
        full = np.flatnonzero(sizes)
        while len(full):
            best = np.full((len(paths), len(texts)), -np.inf)
            for k, p in enumerate(paths):
                best[k, full] = np.maximum.reduceat(p.bound, heads[full])
            source, value = best.argmax(0), best.max(0)
            if len(paths) == self.k or not (value > -np.inf).any():
                break
            # the popped set of each text: its path, the unit it leaves the path at, and the rest drawn anew
            popped = np.flatnonzero(value > -np.inf)
            from_path = np.repeat(source, sizes) if len(paths) > 1 else None

            def of_source(name: str) -> np.ndarray:
                if from_path is None:  # there is one path to split yet
                    return getattr(paths[0], name).copy()
                return np.choose(from_path, [getattr(p, name) for p in paths])

            bound = of_source("bound")
            hit = np.flatnonzero((bound == np.repeat(value, sizes)) & np.repeat(value > -np.inf, sizes))
            text_of = np.repeat(np.arange(len(texts)), sizes)
            hit = hit[np.r_[True, text_of[hit][1:] != text_of[hit][:-1]]]
            start, count, log_p = of_source("start"), of_source("counts"), of_source("log_p")
            split = np.full(len(texts), len(ids))
            split[popped] = hit
            behind = np.flatnonzero(np.arange(len(ids)) > np.repeat(split, sizes))
            path_keys = _mixed(rows + np.uint64(len(paths) * 0x517CC1B727220A95 & _ALL))
            tail_keys = _mixed(np.repeat(path_keys, sizes)[behind] + ordinal[behind])
            tail, tail_counts = lattices.walk(ids[behind], tail_keys)
            start[behind], count[behind] = pooled + np.cumsum(tail_counts) - tail_counts, tail_counts
            log_p[behind] = _sums(lattices.log_p.values[tail], tail_counts)
            pools.append(tail)
            pooled += len(tail)
            new, left, logs = [], np.full(len(hit), -np.inf), lattices.log_p.values
            for n, (text, unit) in enumerate(zip(popped.tolist(), hit.tolist())):
                here = drawn.get((text, source[text], unit))
                if here is None:
                    lo = int(start[unit])
                    k = 0
                    while lo >= len(pools[k]):
                        lo -= len(pools[k])
                        k += 1
                    here = drawn[text, source[text], unit] = [pools[k][lo:lo + int(count[unit])].tolist()]
                other = lattices.other_walk(int(ids[unit]), here, int(path_keys[text]))
                here.append(other)
                start[unit], count[unit] = pooled + len(new), len(other)
                log_p[unit] = sum(logs[e] for e in other)
                new += other
                used = sum(math.exp(sum(logs[e] for e in q)) for q in here)
                if used < 1 - 1e-12:
                    left[n] = math.log1p(-used)
            pools.append(np.array(new, dtype=np.int32))
            pooled += len(new)
            path = _Path(start, count, log_p, heads, sizes)
            path.bound = np.full(len(ids), -np.inf)
            path.bound[behind] = _cut_gumbel((path.prefix + _rest(log_p))[behind], np.repeat(value, sizes)[behind], _uniform(tail_keys, _SPLIT))
            again = _cut_gumbel(path.prefix[hit] + left, value[popped], _uniform(path_keys[popped], _AGAIN))
            for k, p in enumerate(paths):
                mine = source[popped] == k
                p.bound[hit[mine]] = again[mine]
            paths.append(path)
            there.append(value > -np.inf)
        kappa = value if len(full) else np.full(len(texts), -np.inf)
        pool, out = np.concatenate(pools), []
        for path, has in zip(paths, there):
            pieces = lattices.piece.values[pool[_ragged(path.start, path.counts)]]
            ends = np.r_[0, np.cumsum(path.counts)]
            with np.errstate(divide="ignore", over="ignore"):
                inclusion = np.log(-np.expm1(-np.exp(np.minimum(path.total - kappa, 700))))
            out.append(_Drawn(np.flatnonzero(has), pieces, ends[heads], ends[heads + sizes], path.total, inclusion))
        return out

    def sample(self, keys: list[int], texts: list[str]) -> list[list[tuple[np.ndarray, float, float]]]:
        """(pieces, log-probability, log-inclusion) of the paths of each text, the largest perturbed value first."""
        out: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in texts]
        for drawn in self.draw(keys, texts):
            for i in drawn.texts.tolist():
                out[i].append((self._spelt(drawn.pieces[drawn.first[i]:drawn.end[i]]), float(drawn.log_prob[i]), float(drawn.log_inclusion[i])))
        return out

    def piece_lists(self, drawn: _Drawn) -> pa.ListArray:
        """The pieces of the texts that have this path."""
        first, end, pieces = drawn.first[drawn.texts], drawn.end[drawn.texts], drawn.pieces
        if len(drawn.texts) < len(drawn.first):  # texts without this path go
            pieces = pieces[_ragged(first, end - first)]
        offsets = np.r_[0, np.cumsum(end - first)]
        if len(foreign := np.flatnonzero(pieces < 0)):
            as_bytes = [[self.lattices.bytes[b] for b in chr(-1 - p).encode("utf-8", "surrogatepass")] for p in pieces[foreign].tolist()]
            room = np.ones(len(pieces), dtype=np.int64)
            room[foreign] = [len(b) for b in as_bytes]
            places = np.r_[0, np.cumsum(room)]
            pieces = np.repeat(pieces, room)
            pieces[_ragged(places[foreign], room[foreign])] = list(chain.from_iterable(as_bytes))
            offsets = places[offsets]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(pieces.astype(np.int32, copy=False), pa.int32()))

    def _spelt(self, ids: np.ndarray) -> np.ndarray:
        """Vocabulary ids; characters outside the vocabulary become byte pieces."""
        if not len(ids) or ids.min() >= 0:
            return ids
        runs, at = [], 0
        for i in np.flatnonzero(ids < 0).tolist():
            runs += [ids[at:i], np.array([self.lattices.bytes[b] for b in chr(-1 - ids[i]).encode("utf-8", "surrogatepass")], dtype=np.int32)]
            at = i + 1
        return np.concatenate([*runs, ids[at:]])


@lru_cache(maxsize=2)
def sampler(model: str, alpha: float, k: int, seed: int) -> Sampler:
    """One sampler in each Python worker, kept from task to task."""
    return Sampler(model, alpha, k, seed)


def sampled_pieces(docs: DataFrame, model: str, k: int = 2, alpha: float = 0.5, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, and ``samples``: up to ``k`` structs (pieces, log_prob, log_inclusion) of distinct segmentations.

    ``model`` is a vocabulary file that every executor can open.
    """
    ship_package(docs.sparkSession)
    kept = docs.select(F.col(key), F.col(text).alias("__text"))
    item = pa.struct([("pieces", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("log_inclusion", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = sampler(model, alpha, k, seed)
        for batch in batches:
            for part in slices(batch, "__text"):
                keys = [-1 if x is None else x for x in part.column(0).to_pylist()]
                found = made.sample(keys, texts_of(part, "__text"))
                ids = [e for row in found for e, _, _ in row]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                pieces = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32), pa.int32()))
                values = pa.StructArray.from_arrays(
                    [pieces, pa.array([p for row in found for _, p, _ in row], pa.float64()), pa.array([q for row in found for _, _, q in row], pa.float64())],
                    fields=list(item))
                rows = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(rows), values)], [key, "samples"])

    id_type = kept.schema[0].dataType.simpleString()
    return kept.mapInArrow(run, f"`{key}` {id_type}, samples array<struct<pieces:array<int>,log_prob:double,log_inclusion:double>>")


def sample_rows(docs: DataFrame, model: str, k: int = 2, alpha: float = 0.5, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``sampled_pieces``, a row for each sample: key, sample (its number from 0), pieces, log_prob, log_inclusion."""
    ship_package(docs.sparkSession)
    kept = docs.select(F.col(key), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = sampler(model, alpha, k, seed)
        for batch in batches:
            for part in slices(batch, "__text"):
                ids = part.column(0)
                for number, drawn in enumerate(made.draw(pc.fill_null(ids, -1).to_pylist(), texts_of(part, "__text"))):
                    at = drawn.texts
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(at)), pa.array(np.full(len(at), number, dtype=np.int32)), made.piece_lists(drawn),
                         pa.array(drawn.log_prob[at]), pa.array(drawn.log_inclusion[at])],
                        [key, "sample", "pieces", "log_prob", "log_inclusion"])

    id_type = kept.schema[0].dataType.simpleString()
    return kept.mapInArrow(run, f"`{key}` {id_type}, sample int, pieces array<int>, log_prob double, log_inclusion double")


@lru_cache(maxsize=2)
def _piece_bytes(model: str) -> list[bytes]:
    import sentencepiece

    vocabulary = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = [vocabulary.id_to_piece(k) for k in range(vocabulary.get_piece_size())]
    return [bytes([int(t[3:5], 16)]) if vocabulary.is_byte(k) else t.replace(MARK, " ").encode() for k, t in enumerate(texts)]


def decode(pieces: list[int], model: str) -> str:
    """The text of a segmentation; the mark put before every text is taken off again."""
    known = _piece_bytes(model)
    return b"".join([known[k] for k in pieces])[1:].decode("utf-8", "replace")


def decoded_texts(samples: DataFrame, model: str, pieces: str = "pieces", out: str = "text") -> DataFrame:
    """``samples`` with the text that each row's pieces stand for; null pieces give null."""

    ship_package(samples.sparkSession)

    @F.pandas_udf("string")
    def decoded(column):
        return column.map(lambda p: None if p is None else decode(p, model))

    return samples.withColumn(out, decoded(F.col(pieces)))
