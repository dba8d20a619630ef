"""Sampled SentencePiece segmentations without replacement, and decoding.

A text's segmentations are the paths of a lattice of vocabulary pieces. Pieces
weigh as unigrams with Zipf weights by vocabulary order, so a segmentation has a
probability. Gumbel top-k draws k distinct segmentations: every path gets a
Gumbel-perturbed log-probability and the k largest win. The search is A-star over
sets of paths: a set is a prefix with some next pieces excluded, its priority is
the perturbed maximum of the set, drawn under the limit of the set it was split
from, and its bound is exact because backward sums give each set's mass. Popping a
set completes its best path by sampling onwards and splits off the rest.

No piece crosses the start of a run of spaces, so lattices are built once per
distinct pre-token of a block of texts, for all of them at once.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from functools import lru_cache
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatloom.llm.text import keyed, map_batches, schema_of, texts
from beatloom.llm.token_counts import MARK, PRE_TOKEN

BLOCK = 1_500_000  # characters whose lattices are built together
_PRIME = np.uint64(0x100000001B3)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(key: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """In (0, 1), a function of row key and counter alone."""
    x = _mix(key + counter.astype(np.uint64) * _GOLD)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Pieces:
    """Vocabulary with unigram log-probabilities and a prefix hash table."""

    def __init__(self, model: str, power: float = 1.0):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        if any(MARK in p.lstrip(MARK) for p in names):
            raise ValueError("pre-tokens of this model are not independent")
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        rank = np.arange(1, len(plain) + 2, dtype=np.float64)
        log = -power * np.log(rank) - np.log((rank**-power).sum())
        self.logp = np.full(n, log[-1])  # bytes weigh like the rarest piece
        self.logp[plain] = log[:-1]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.longest = max(len(names[i]) for i in plain)
        # hash of every prefix of a piece -> its id, -1 if only a prefix
        table: dict[int, int] = {}
        for i in plain:
            h = 0
            for c in names[i]:
                h = self.step_int(h, ord(c))
                table.setdefault(h, -1)
            table[h] = i
        # open addressing, a few hundredths full
        self.keys, self.ids = np.zeros(1 << 20, dtype=np.uint64), np.full(1 << 20, -2, dtype=np.int32)
        for h, i in table.items():
            at = h >> 44
            while self.ids[at] != -2:
                at = (at + 1) & 0xFFFFF
            self.keys[at], self.ids[at] = h, i
        # decoding: bytes of each piece, the mark as a space
        raw = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        self.bytes = raw

    @staticmethod
    def step_int(h: int, c: int) -> int:
        return ((h ^ (c + 1)) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & ((1 << 64) - 1)

    @staticmethod
    def step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (h ^ (c + np.uint64(1))) * _GOLD + np.uint64(0x632BE59BD9B4E019)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Id of a piece, -1 of a prefix, -2 of neither."""
        at = (h >> np.uint64(44)).astype(np.int64)
        out = self.ids[at]
        todo = np.flatnonzero((self.keys[at] != h) & (out != -2))
        while len(todo):
            at[todo] = (at[todo] + 1) & 0xFFFFF
            out[todo] = self.ids[at[todo]]
            todo = todo[(self.keys[at[todo]] != h[todo]) & (out[todo] != -2)]
        return out


@lru_cache(maxsize=2)
def pieces_of(model: str, power: float) -> Pieces:
    return Pieces(model, power)


class Lattice(NamedTuple):
    """Joint lattice of some words. A word's states are its characters (its bytes
    where no piece covers a character) and an end; edges are sorted by state,
    longer pieces first."""

    start: np.ndarray  # first state of each word
    first: np.ndarray  # first edge of each state; an end has none
    cum: np.ndarray  # cumulative probability within a state
    to: np.ndarray
    piece: np.ndarray
    logc: np.ndarray  # log-probability of the edge given its state


def build_lattice(p: Pieces, words: list[str]) -> Lattice:
    chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    stop = np.repeat(np.cumsum(length), length)  # end of the word of each character
    n = len(chars)
    src, to, ids = [], [], []
    covered = np.zeros(n, dtype=bool)
    alive, h = np.arange(n, dtype=np.int32), np.zeros(n, dtype=np.uint64)
    for size in range(1, p.longest + 1):
        h = p.step(h, chars[alive + (size - 1)])
        hit = p.find(h)
        piece = hit >= 0
        src.append(alive[piece])
        to.append(src[-1] + size)
        ids.append(hit[piece])
        if size == 1:
            covered[src[0]] = True
        on = (hit > -2) & (alive + size < stop[alive])
        alive, h = alive[on], h[on]
        if not len(alive):
            break
    # states: one per character, more for the bytes of an uncovered one, one end per word
    width = np.ones(n, dtype=np.int64)
    bare = np.flatnonzero(~covered)
    code = chars[bare].astype(np.int64)
    width[bare] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    word = np.repeat(np.arange(len(words)), length)
    state = np.concatenate([[0], np.cumsum(width)])[:-1] + word
    ends = np.cumsum(np.bincount(word, weights=width, minlength=len(words)).astype(np.int64) + 1) - 1
    n_states = int(ends[-1]) + 1 if len(words) else 0
    start = np.concatenate([[0], ends[:-1] + 1]) if len(words) else np.empty(0, dtype=np.int64)
    # state behind a piece: that of the next character, or the end of the word
    after = np.concatenate([state, [n_states - 1]])
    s = np.concatenate([*src[::-1], np.empty(0, dtype=np.int32)])
    e = np.concatenate([*to[::-1], np.empty(0, dtype=np.int32)])
    i = np.concatenate([*ids[::-1], np.empty(0, dtype=np.int32)])
    e_state = np.where(e == stop[s], ends[word[s]], after[e]).astype(np.int32)
    s_state = state[s].astype(np.int32)
    del src, to, ids, s, e, h, alive
    # byte chains
    more_s, more_e, more_i = [], [], []
    for b in bare.tolist():
        raw = chr(int(chars[b])).encode()
        more_s += range(int(state[b]), int(state[b]) + len(raw))
        more_i += p.byte_ids[list(raw)].tolist()
    more_e = [x + 1 for x in more_s]
    s_state = np.concatenate([s_state, np.array(more_s, dtype=np.int32)])
    e_state = np.concatenate([e_state, np.array(more_e, dtype=np.int32)])
    i = np.concatenate([i, np.array(more_i, dtype=np.int32)])
    # backward sums: states by their distance from the end of the word
    order = np.argsort(s_state, kind="stable")
    s_state, e_state, i = s_state[order], e_state[order], i[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(s_state, minlength=n_states))])
    dist = np.repeat(ends, ends - start + 1) - np.arange(n_states)
    if len(dist) and dist.max() < 1 << 16:
        dist = dist.astype(np.uint16)  # sorts by digits
    beta = np.zeros(n_states)
    logw = p.logp[i]
    by_dist = np.argsort(dist, kind="stable")
    cut = np.searchsorted(dist[by_dist], np.arange(1, int(dist.max(initial=0)) + 2))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        st = by_dist[a:b]
        deg = first[st + 1] - first[st]
        edges = np.repeat(first[st] - np.concatenate([[0], np.cumsum(deg)[:-1]]), deg) + np.arange(int(deg.sum()))
        w = np.exp(logw[edges] + beta[e_state[edges]] - (top := beta[st + 1])[np.repeat(np.arange(len(st)), deg)])
        beta[st] = top + np.log(np.add.reduceat(w, np.concatenate([[0], np.cumsum(deg)[:-1]])))
    logc = logw + beta[e_state] - beta[s_state]
    cum = np.exp(logc)
    at = first[:-1][np.diff(first) > 1] + 1  # the second edge of each state, then the third ...
    stop_at = first[1:][np.diff(first) > 1]
    while len(at):
        cum[at] += cum[at - 1]
        at, stop_at = at[at + 1 < stop_at] + 1, stop_at[at + 1 < stop_at]
    cum[first[1:][first[1:] > first[:-1]] - 1] = 2.0  # the last edge takes what rounding leaves
    return Lattice(start, first, cum, e_state, i.astype(np.int32), logc)


class Walk(NamedTuple):
    """Sampled paths of all words, tokens in text order."""

    offset: np.ndarray  # first token of each word occurrence, and the end
    state: np.ndarray
    edge: np.ndarray


def walk(lat: Lattice, word: np.ndarray, key: np.ndarray, place: np.ndarray, sample: int) -> Walk:
    """Sample every word occurrence; the draws depend on the row key, the place of
    the word in its text, the place in the word and the number of the sample."""
    n = len(word)
    base = lat.start[word]
    at = base.copy()
    live = np.flatnonzero(lat.first[at + 1] > lat.first[at])
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count = np.zeros(n, dtype=np.int64)
    salt = np.uint64(sample + 1) << np.uint64(48)
    while len(live):
        s = at[live]
        u = uniforms(key[live], (place[live] + s - base[live]).astype(np.uint64) + salt)
        edge = lat.first[s]
        behind = np.flatnonzero(u >= lat.cum[edge])
        while len(behind):
            edge[behind] += 1
            behind = behind[u[behind] >= lat.cum[edge[behind]]]
        steps.append((live, s, edge))
        count[live] += 1
        at[live] = s = lat.to[edge]
        live = live[lat.first[s + 1] > lat.first[s]]
    offset = np.concatenate([[0], np.cumsum(count)])
    state, edges = np.empty(offset[-1], dtype=np.int32), np.empty(offset[-1], dtype=np.int32)
    for t, (who, s, e) in enumerate(steps):
        state[offset[who] + t] = s
        edges[offset[who] + t] = e
    return Walk(offset, state, edges)


def _below(limit: float | np.ndarray, log_mass: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Maximum of a set with this mass, given that it is below ``limit``."""
    with np.errstate(over="ignore", divide="ignore"):
        return -np.logaddexp(-limit, np.log(-np.log(u)) - log_mass)


class Sample(NamedTuple):
    ids: np.ndarray
    log_prob: float
    perturbed: float
    log_inclusion: float


HEAD = 384  # tokens of a path that are looked at together
POOL = 64  # draws of a text in one step of the search
_SETS, _STEPS, _MORE = (np.uint64(n) << np.uint64(56) for n in (1, 2, 3))


class Search:
    """A-star search over the texts of a block, one step of all texts at a time.

    ``walks[j]`` supplies the completions of the j-th popped set behind the word
    in which it leaves its parent.
    """

    def __init__(self, lat: Lattice, walks: list[Walk], bounds: np.ndarray, rows: list[int], k: int):
        self.lat, self.walks, self.bounds, self.k = lat, walks, bounds, k
        self.keys = np.array(rows, dtype=np.uint64)
        n = len(rows)
        self.paths: list[list[np.ndarray]] = [[] for _ in range(n)]
        self.scores: list[list[float]] = [[] for _ in range(n)]
        self.queue: list[list[tuple[float, int, int, tuple[int, ...]]]] = [[] for _ in range(n)]
        self.used = np.zeros(n, dtype=np.int64)

    def run(self) -> None:
        w, o = self.walks[0], self.walks[0].offset[self.bounds]
        full = np.flatnonzero(np.diff(o) > 0)
        first = [w.edge[o[d] : o[d + 1]] for d in full.tolist()]
        limit = -np.log(-np.log(uniforms(self.keys[full], _STEPS + np.zeros(len(full), dtype=np.uint64))))
        self._add(full, first, np.zeros(len(full), dtype=np.int64), limit)
        for step in range(1, self.k):
            open_ = np.array([d for d in full.tolist() if self.queue[d]], dtype=np.int64)
            if not len(open_):
                break
            at = _STEPS + np.uint64(step * POOL) + np.arange(POOL, dtype=np.uint64)
            draws = uniforms(np.repeat(self.keys[open_], POOL), np.tile(at, len(open_))).reshape(-1, POOL)
            new = [self._pop(d, step, u) for d, u in zip(open_.tolist(), draws)]
            self._add(open_, [p for p, _, _ in new], np.array([b for _, b, _ in new]), np.array([g for _, _, g in new]))

    def _add(self, docs: np.ndarray, paths: list[np.ndarray], begin: np.ndarray, limit: np.ndarray) -> None:
        """Take a path per text and queue the best sets that leave it at token
        ``begin`` or later, all below ``limit``.

        Sets with less than e^-40 of the mass behind ``begin`` are beyond the
        precision of the draws and left out.
        """
        head = HEAD
        logc = self.lat.logc
        base = np.array([logc[p[:b]].sum() for p, b in zip(paths, begin.tolist())])
        for d, p, g in zip(docs.tolist(), paths, limit.tolist()):
            self.paths[d].append(p)
            self.scores[d].append(g)
        todo = np.arange(len(docs))
        while len(todo):
            cut = [paths[i][begin[i] : begin[i] + head] for i in todo.tolist()]
            size = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
            real = np.arange(head) < size[:, None]
            grid = np.zeros((len(cut), head))
            grid[real] = logc[np.concatenate(cut)]
            before = np.cumsum(grid, axis=1) - grid
            longer = np.array([len(paths[i]) - begin[i] > head for i in todo.tolist()])
            again = longer & (before[:, -1] >= -40.0)
            left = -np.expm1(grid)
            row, place = np.nonzero(real & (left > 1e-12) & (before >= -40.0) & ~again[:, None])
            who = todo[row]
            mass = base[who] + before[row, place] + np.log(left[row, place])
            u = uniforms(self.keys[docs[who]], _SETS + (self.used[docs[who]] + place).astype(np.uint64))
            best = _below(limit[who], mass, u)
            order = np.lexsort((-best, who))
            rank = np.arange(len(order)) - np.searchsorted(who[order], who[order])
            for j in order[rank <= self.k].tolist():
                d = int(docs[who[j]])
                at = int(begin[who[j]] + place[j])
                heapq.heappush(self.queue[d], (-float(best[j]), len(self.paths[d]) - 1, at, (int(self.paths[d][-1][at]),)))
            self.used[docs[todo[~again]]] += head
            todo, head = todo[again], head * 4

    def _pop(self, d: int, step: int, draws: np.ndarray) -> tuple[np.ndarray, int, float]:
        """Complete the best set of a text and split the rest of it off: the new
        path, where its own sets begin, and their limit."""
        lat, pool = self.lat, draws.tolist()
        key, count = self.keys[d : d + 1], 0

        def draw() -> float:
            nonlocal count
            if pool:
                return pool.pop()
            count += 1
            return float(uniforms(key, np.array([_MORE + np.uint64((step << 32) + count)]))[0])

        g, parent, at, out = heapq.heappop(self.queue[d])
        old = self.paths[d][parent]
        state = int(np.searchsorted(lat.first, old[at], side="right") - 1)
        options = [e for e in range(int(lat.first[state]), int(lat.first[state + 1])) if e not in out]
        p = np.exp(lat.logc[options])
        pick = options[min(int(np.searchsorted(np.cumsum(p), draw() * p.sum(), side="right")), len(options) - 1)]
        left = 1.0 - float(np.exp(lat.logc[[*out, pick]]).sum())
        if len(options) > 1 and left > 1e-12:
            mass = float(lat.logc[old[:at]].sum()) + np.log(left)
            heapq.heappush(self.queue[d], (-float(_below(-g, mass, draw())), parent, at, (*out, pick)))
        # on to the end of the word, then the words behind it
        tail, s = [pick], int(lat.to[pick])
        while lat.first[s + 1] > lat.first[s]:
            e, u = int(lat.first[s]), draw()
            while u >= lat.cum[e]:
                e += 1
            tail.append(e)
            s = int(lat.to[e])
        # words that end before the place where the path leaves the old one
        ends = lat.to[old[:at]]
        done = int((lat.first[ends + 1] == lat.first[ends]).sum())
        nxt = self.walks[step]
        words = nxt.edge[nxt.offset[self.bounds[d] + done + 1] : nxt.offset[self.bounds[d + 1]]]
        return np.concatenate([old[:at], np.array(tail, dtype=np.int32), words]), at + 1, -g

    def samples(self, d: int) -> list[Sample]:
        kappa = -self.queue[d][0][0] if self.queue[d] else -np.inf
        out = []
        for x, g in zip(self.paths[d], self.scores[d]):
            lp = float(self.lat.logc[x].sum())
            out.append(Sample(self.lat.piece[x], lp, float(g), _log_above(lp - kappa)))
        return out


def _log_above(x: float) -> float:
    """log(1 - exp(-exp(x))): a Gumbel of this log-probability is above the bound."""
    return 0.0 if x > 4.0 else x if x < -30.0 else float(np.log(-np.expm1(-np.exp(x))))


def row_seed(key: object, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(repr(key).encode(), seed=seed)


def split_words(text: str) -> list[str]:
    """Pre-tokens without their first space mark."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
        return [w[1:] for w in PRE_TOKEN.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


def sample_block(p: Pieces, block: list[str], rows: list[int], k: int) -> list[list[Sample]]:
    """k samples of every text of a block."""
    number: defaultdict[str, int] = defaultdict(count().__next__)
    split = [np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words)) for words in map(split_words, block)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
    word = np.concatenate(split)
    names = [MARK + w for w in number]
    lat = build_lattice(p, names)
    size = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
    # the place of a word: characters (times four, for bytes) before it in its text
    ahead = np.concatenate([[0], np.cumsum(size[word] * 4 + 1)])
    counts = np.diff(bounds)
    place = ahead[:-1] - np.repeat(ahead[bounds[:-1]], counts)
    key = np.repeat(np.array(rows, dtype=np.uint64), counts)
    walks = [walk(lat, word, key, place, j) for j in range(k)]
    search = Search(lat, walks, bounds, rows, k)
    search.run()
    return [search.samples(d) for d in range(len(rows))]


def sample_segmentations(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", k: int = 2, seed: int = 17, power: float = 1.0,
) -> DataFrame:
    """Up to k rows per document: ``key``, ``sample``, ``ids``, ``log_prob``,
    ``perturbed``, ``log_inclusion`` and ``round_trip``: whether the decoded ids are
    the text, byte by byte.

    The segmentations of a row are distinct, in falling order of their perturbed
    log-probability, and a function of the row's key, text and ``seed`` alone, so
    equal rows get equal samples and a repeated task repeats its result.
    ``log_inclusion`` is the log-probability that the segmentation is above the
    (k+1)-th perturbed value; 0 where a text has no more than k segmentations.
    ``log_prob - log_inclusion`` is its importance weight. Null and empty texts
    have one empty segmentation.
    """
    d = keyed(docs, key, text)

    def run(batches):
        p = pieces_of(model, power)
        for batch in batches:
            keys, all_ = batch.column(key).to_pylist(), texts(batch)
            at = 0
            while at < len(all_):
                to, size = at, 0
                while to < len(all_) and (to == at or size + len(all_[to]) <= BLOCK):
                    size += len(all_[to])
                    to += 1
                found = sample_block(p, all_[at:to], [row_seed(x, seed) for x in keys[at:to]], k)
                rows = [(i, j, s) for i, ss in enumerate(found) for j, s in enumerate(ss or [Sample(np.empty(0, np.int32), 0.0, 0.0, 0.0)])]
                ends = np.concatenate([[0], np.cumsum([len(s.ids) for _, _, s in rows])]).astype(np.int32)
                flat = np.concatenate([s.ids for _, _, s in rows])
                yield {
                    key: batch.column(key).slice(at, to - at).take(pa.array([i for i, _, _ in rows])),
                    "sample": [j for _, j, _ in rows],
                    "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())),
                    "log_prob": [s.log_prob for _, _, s in rows],
                    "perturbed": [s.perturbed for _, _, s in rows],
                    "log_inclusion": [s.log_inclusion for _, _, s in rows],
                    "round_trip": [decode_bytes(p, s.ids.tolist()) == all_[at + i].encode() for i, _, s in rows],
                }
                at = to

    return map_batches(d, run, schema_of(d, key, "sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double, round_trip boolean"))


def decode_bytes(p: Pieces, ids: list[int]) -> bytes:
    out = b"".join(map(p.bytes.__getitem__, ids))
    return out[1:] if out[:1] == b" " else out


def decode(encoded: DataFrame, model: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """The rows with a column ``to``: the text of a list of piece ids. Space marks
    become spaces, the first one goes; bytes that are no UTF-8 become U+FFFD. A
    null list gives null."""
    d = encoded.withColumn(to, F.lit(None).cast("string"))

    def run(batches):
        p = pieces_of(model, 1.0)
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns))
            yield cols | {to: [None if x is None else decode_bytes(p, x).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]}

    return map_batches(d, run, d.schema)
