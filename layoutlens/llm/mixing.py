"""Logistic context mixing of byte contexts, in numpy: places, a binary code, bit predictors, gated weights, a refining map.

A place of a lower-cased text is one number of 56 bits: the six bytes before it (latest first, BEFORE where the text has not
begun) and its own byte, or END. Capitals never occur, so BEFORE and END take two of their values and a place is exact:
there is nothing to collide. In order of these numbers the places of one context lie side by side, at every order.

A byte is coded by binary decisions down a fixed tree that halves the training counts while it keeps the order of the
bytes; only the bytes that can occur and END are leaves, so the probabilities of a context add up to one. For each order of ORDERS
a predictor gives the stretched probability of a decision from the counts of its context; a gate (the highest order whose
context was met, and the depth) selects the weights that add the predictors up, and a refining map over the gate and the
mixed value corrects what is left. Weights and map are learned from every training decision, its own count left out, by
Newton steps and bounded steps. `costs` does so for one shard: a set of contexts with all of their places, so each shard
has weights and a map of its own. While a text is scored, `adapted` goes on to refine the probabilities by what the text has shown so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from layoutlens.llm.shingles import mix

ORDERS = (1, 2, 3, 4, 6)
BEFORE, END = 65, 66
PIECE_BYTES = 500_000
DEPTHS = 4
GATES = (len(ORDERS) + 1) * DEPTHS
CELLS = 33
#: Own bytes of places, in order: all but capitals, and END.
SYMBOLS = np.array([b for b in range(256) if not 65 <= b <= 90 or b == END])
_BYTE = np.uint64(255)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# -- places -----------------------------------------------------------------------------------------------------------
Segment = tuple[bytes, bytes, bool]


def segments(texts: list[bytes], size: int = PIECE_BYTES) -> Iterator[tuple[list[int], list[Segment]]]:
    """Runs of some `size` bytes: the number of each segment's text, and (its bytes, up to six before, whether it ends the text)."""
    owner, run, held = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text)), size):
            part = text[at : at + size]
            if run and held + len(part) > size:
                yield owner, run
                owner, run, held = [], [], 0
            owner.append(k)
            run.append((part, text[max(0, at - 6) : at], at + size >= len(text)))
            held += len(part)
    if run:
        yield owner, run


def laid(run: list[Segment]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of the segments, LEAD bytes before each and an END after a text's last; where each segment's own begin and stop."""
    parts, sizes = [], []
    for part, before, last in run:
        parts.append(_PAD[len(before) :] + before.translate(_TABLE) + part.translate(_TABLE) + (_END if last else b""))
        sizes.append(len(part) + last)
    stops = np.cumsum(np.array(sizes) + LEAD)
    return np.frombuffer(b"".join(parts), dtype=np.uint8), stops - np.array(sizes), stops


def places(run: list[Segment]) -> tuple[np.ndarray, np.ndarray]:
    """The number of every place of the segments, and the segment it belongs to."""
    data, starts, stops = laid(run)
    # The eight bytes up to each byte, read as one number: its own byte on top, the byte before it next, and so on.
    wide = np.ndarray(shape=len(data) - LEAD, dtype="<u8", buffer=data, strides=(1,))
    inside = np.ones(len(data), dtype=bool)
    for k in range(LEAD):
        inside[starts - LEAD + k] = False
    wide = wide[inside[LEAD:]]
    sizes = stops - starts
    return (wide & np.uint64(0x00FFFFFFFFFFFF00)) | (wide >> np.uint64(56)), np.repeat(np.arange(len(run), dtype=np.int32), sizes)


LEAD = 7
_TABLE = _LOWER.tobytes()
_END = bytes([END])
_PAD = bytes([BEFORE]) * LEAD


def marked(keys: np.ndarray, learn: np.ndarray) -> np.ndarray:
    """Numbers of 63 bits at most with a last bit for what is learned from."""
    found = keys << np.uint64(1)
    found |= learn
    return found


def taught(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of `marked` numbers, which are used up: the distinct ones in order, and how often each is learned from."""
    found, at = np.empty(sum(map(len, parts)), dtype=np.uint64), 0
    while parts:
        part = parts.pop()
        found[at : at + len(part)] = part
        at += len(part)
    found.sort()
    total = np.cumsum(found.view(np.uint8)[::8] & np.uint8(1), dtype=np.int32)
    found >>= np.uint64(1)
    first = _starts(found)
    upto = total[np.append(first[1:], len(found)) - 1] if len(first) else total
    return found[first], np.diff(upto, prepend=np.int32(0)).astype(np.int64)


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct numbers in order; `keys` itself is sorted."""
    keys.sort()
    return keys[_starts(keys)]


#: Bytes that part words.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A number of 63 bits (a hash) for each word of the texts, A-Z lower-cased, and how many words each text has."""
    data = np.frombuffer(b" ".join([*texts, b""]).translate(_TABLE), dtype=np.uint8)
    edge = np.diff(~_SPACE[data], prepend=False, append=False).nonzero()[0]
    starts, stops = edge[::2], edge[1::2]
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
    found = mix((total[stops] - total[starts]) * inverse[starts]) >> np.uint64(1)
    ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    return found, np.diff(np.searchsorted(starts, ends), prepend=0)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; those of a piece are kept."""
    if n <= len(_KEPT[0]):
        return _KEPT[0][:n], _KEPT[1][:n]
    made = []
    for base in (_BASE, _INVERSE):
        one = np.full(max(n, 2 * PIECE_BYTES), base, dtype=np.uint64)
        one[0] = 1
        made.append(np.multiply.accumulate(one))
    if n <= 2 * PIECE_BYTES:
        _KEPT[:] = made
    return made[0][:n], made[1][:n]


_KEPT = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and how often each occurs (or the sum of its counts)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    first = _starts(keys)
    if counts is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    return summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


def _starts(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    if not len(values):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


# -- dealing ----------------------------------------------------------------------------------------------------------
#: Contexts of so many bytes may be split into longer ones where they hold too much for one shard.
LEVELS = (2, 3, 4, 5)


def context(keys: np.ndarray, order: int) -> np.ndarray:
    return keys >> np.uint64(56 - 8 * order)


def heavy(keys: np.ndarray, share: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Marks (level, context) of the contexts that hold over one in `share` of the distinct places, and how many."""
    marks, sizes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for level in LEVELS:
        first = _starts(context(keys, level))
        size = np.diff(np.append(first, len(keys)))
        much = size > len(keys) // share
        marks.append((context(keys, level)[first[much]] | np.uint64(level << 48)).astype(np.int64))
        sizes.append(size[much])
    return np.concatenate(marks), np.concatenate(sizes)


def dealt(keys: np.ndarray, shards: int, split: np.ndarray) -> np.ndarray:
    """The shard of each place: by hash of its last two bytes, or of as many more as leave the marks of `split` (sorted)."""
    found = np.zeros(len(keys), dtype=np.int64)
    todo, level = np.arange(len(keys)), LEVELS[0]
    while len(todo):
        own = context(keys[todo], level)
        mark = (own | np.uint64(level << 48)).astype(np.int64)
        at = np.searchsorted(split, mark)
        on = split[np.minimum(at, len(split) - 1)] == mark if len(split) and level <= LEVELS[-1] else np.zeros(len(todo), dtype=bool)
        h = (own[~on] + np.uint64(level << 48)) * np.uint64(0x9E3779B97F4A7C15)
        found[todo[~on]] = ((h ^ h >> np.uint64(29)) >> np.uint64(16)).astype(np.int64) % shards
        todo, level = todo[on], level + 1
    return found


def by_shard(shard: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(shard, the places that it gets, in order)."""
    order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 65_536 else shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    return [(int(shard[part[0]]), part) for part in np.split(order, cuts) if len(part)]


def packed(numbers: np.ndarray) -> bytes:
    """Sorted numbers of 8 bytes as planes of bytes of their differences, which compress well."""
    return np.diff(numbers, prepend=numbers.dtype.type(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts in the narrowest type that holds them, its size first."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def unpacked_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], dtype=f"u{data[0]}").astype(np.int64)


# -- code and predictors ----------------------------------------------------------------------------------------------
class Code:
    """A binary tree over SYMBOLS in their order: for each byte value its length, and the node and bit at each depth."""

    def __init__(self, counts: np.ndarray) -> None:
        weight = np.concatenate([[0.0], np.cumsum(counts[SYMBOLS] + 1.0)])
        path: dict[int, list[tuple[int, int]]] = {int(s): [] for s in SYMBOLS}
        self.nodes: list[int] = []
        todo = [(0, len(SYMBOLS), 0)]
        while todo:
            a, b, depth = todo.pop()
            if b - a == 1:
                continue
            if len(self.nodes) == depth:
                self.nodes.append(0)
            node = self.nodes[depth]
            self.nodes[depth] += 1
            middle = int(np.abs(2 * weight[a + 1 : b] - weight[a] - weight[b]).argmin()) + a + 1
            for k in range(a, b):
                path[int(SYMBOLS[k])].append((node, int(k >= middle)))
            todo += [(a, middle, depth + 1), (middle, b, depth + 1)]
        self.length = np.zeros(256, dtype=np.int64)
        self.node, self.bit = np.zeros((len(self.nodes), 256), dtype=np.int64), np.zeros((len(self.nodes), 256), dtype=np.uint8)
        for symbol, steps in path.items():
            self.length[symbol] = len(steps)
            for depth, (node, bit) in enumerate(steps):
                self.node[depth, symbol], self.bit[depth, symbol] = node, bit


class Common:
    """What all shards share, of a fixed size: the code, and the counts of order 1 at each depth by byte before and node."""

    def __init__(self, pairs: np.ndarray) -> None:
        """`pairs`: 256 x 256 training counts by the byte before and the own one."""
        self.code = Code(pairs.sum(axis=0))
        self.first = []
        for depth, n in enumerate(self.code.nodes):
            on = np.flatnonzero(self.code.length > depth)
            to = np.zeros((256, n))
            to[on, self.code.node[depth, on]] = 1
            self.first.append(tuple((pairs @ m).astype(np.int64) for m in (to * self.code.bit[depth][:, None], to)))


_FACTOR = np.minimum(np.arange(8) / 8 + 0.3, 1.2)
#: Counts below have a table; from here on the trust is the same.
_SMALL = 128


def _stretched(ones: np.ndarray, seen: np.ndarray) -> np.ndarray:
    ones = np.minimum(ones, seen)
    p = (ones + 0.25) / (seen + 0.5)
    trust = _FACTOR[np.minimum(np.ceil(np.log2(np.maximum(seen, 0) + 1)), 7).astype(np.int8)]
    return np.where(seen > 0, np.log(p / (1 - p)) * trust, 0).astype(np.float32)


_TABLED = _stretched(np.tile(np.arange(_SMALL), _SMALL), np.repeat(np.arange(_SMALL), _SMALL))


def predictions(ones: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """float32: the stretched probability of each pair of counts times its trust; 0 where nothing was seen."""
    low = seen < _SMALL
    found = _TABLED[np.where(low, seen * _SMALL + ones, 0)]
    if not low.all():
        far = np.flatnonzero(~low)
        hits = ones[far]
        found[far] = _FACTOR[-1] * np.log((hits + 0.25) / (seen[far] - hits + 0.25))
    return found


def _met(seen: list[np.ndarray]) -> np.ndarray:
    """One more than the place of the highest order that was met, or 0."""
    found = np.zeros(len(seen[0]), dtype=np.uint8)
    for k, s in enumerate(seen):
        found[s > 0] = k + 1
    return found


def decisions(keys: np.ndarray, counts: np.ndarray, common: Common) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """depth, the places that decide there, their bits, and the counts (ones, seen) of every order, for sorted places."""
    code, symbol = common.code, (keys & _BYTE).astype(np.int64)
    length = code.length[symbol]
    on = np.arange(len(keys))
    for depth, nodes in enumerate(code.nodes):
        on = on[length[on] > depth] if depth else on[length[on] > 0]
        if not len(on):
            return
        own, sym = keys[on], symbol[on]
        node, bit, weight = code.node[depth, sym], code.bit[depth, sym], counts[on]
        ones, seen = [], []
        for order in ORDERS:
            if order == 1:
                spot = (own >> np.uint64(48)).astype(np.int64)
                for out, table in zip((ones, seen), common.first[depth], strict=True):
                    out.append(table[spot, node])
                continue
            if order == 6:
                # The code keeps the order of the bytes, so one node's places of a context lie side by side.
                first = _starts((own & ~_BYTE) + node.astype(np.uint64))
                sizes = np.diff(np.append(first, len(own)))
                ones.append(np.repeat(np.add.reduceat(weight * bit, first), sizes))
                seen.append(np.repeat(np.add.reduceat(weight, first), sizes))
                continue
            first = _starts(context(own, order))
            slot = np.repeat(np.arange(len(first)) * nodes, np.diff(np.append(first, len(own)))) + node
            for out, w in ((ones, weight * bit), (seen, weight)):
                out.append(np.bincount(slot, weights=w).astype(np.int64)[slot])
        yield depth, on, bit, ones, seen


# -- weights and map --------------------------------------------------------------------------------------------------
def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def _loss(z: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Minus the natural logarithm of the probability of `bit`."""
    s = np.where(bit, -z, z)
    return np.log1p(np.exp(-np.abs(s))) + np.maximum(s, 0)


class Gate:
    """Weights and refining map of one gate."""

    def __init__(self) -> None:
        self.weights = np.full(len(ORDERS), 0.3)
        self.map = np.linspace(-8, 8, CELLS)

    def mixed(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.weights.astype(np.float32) @ x, -7.99, 7.99)

    def _cells(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spot = (z + np.float32(8)) * np.float32((CELLS - 1) / 16)
        low = spot.astype(np.int32)
        return low, spot - low

    def refined(self, z: np.ndarray) -> np.ndarray:
        low, high = self._cells(z)
        flat = self.map.astype(z.dtype)
        return z.dtype.type(0.5) * (z + flat[low] + (flat[low + 1] - flat[low]) * high)

    def learn(self, x: np.ndarray, bit: np.ndarray, weight: np.ndarray, weight_passes: int = 4, map_passes: int = 2) -> None:
        """Newton steps of the weights, halved where the loss rose; then steps of the map that its curvature bounds.

        A little curvature of our own keeps what was rarely met near its start.
        """
        start = self.weights
        best, step, lowest = start, np.zeros(len(start)), np.inf
        for _ in range(weight_passes):
            now = best + step
            z = np.clip(now.astype(np.float32) @ x, -20, 20)
            loss = float(weight @ _loss(z, bit)) + 0.5 * float(((now - start) ** 2).sum())
            if loss > lowest:
                step = step / 2
                continue
            gain, lowest, best = lowest - loss, loss, now
            if gain < 1e-4 * loss:
                break
            p = _squash(z)
            bend = ((x * (weight * p * (1 - p))) @ x.T).astype(np.float64) + np.eye(len(now))
            step = np.linalg.solve(bend, (x @ (weight * (bit - p))).astype(np.float64) - (now - start))
        self.weights = best
        z = self.mixed(x)
        low, high = self._cells(z)
        for _ in range(map_passes):
            p = _squash(self.refined(z))
            error, bend = weight * (bit - p), weight * p * (1 - p)
            up, down = np.zeros(CELLS), np.zeros(CELLS)
            for side, share in ((0, 1 - high), (1, high)):
                up += np.bincount(low + side, weights=share * error, minlength=CELLS)
                down += np.bincount(low + side, weights=share * bend, minlength=CELLS)
            self.map = np.clip(self.map + 0.5 * up / (0.25 * down + 1), -12, 12)


def costs(keys: np.ndarray, counts: np.ndarray, common: Common) -> np.ndarray:
    """Minus the natural logarithm of the probability of each of the sorted distinct places.

    `counts` are those of the training texts, 0 for places that are only looked up. What is not in `keys` of the contexts
    of orders 2 and more counts as never met, so a shard must get its contexts whole.
    """
    asked, learned = [], [[] for _ in range(GATES)]
    for depth, on, bit, ones, seen in decisions(keys, counts, common):
        level = min(depth, DEPTHS - 1)
        weight = counts[on]
        some = np.flatnonzero(weight > 0)
        own_bit, weight = bit[some], weight[some].astype(np.float32)
        less = [s[some] - 1 for s in seen]
        x = np.stack([predictions(o[some] - own_bit, s) for o, s in zip(ones, less, strict=True)])
        for met, part in by_shard(_met(less)):
            learned[met * DEPTHS + level].append((x[:, part], own_bit[part].astype(bool), weight[part]))
        asked.append((on, bit, _met(seen) * np.uint8(DEPTHS) + np.uint8(level), np.stack([predictions(o, s) for o, s in zip(ones, seen, strict=True)])))
    gates = [Gate() for _ in range(GATES)]
    for g, rows in enumerate(learned):
        if rows:
            gates[g].learn(*(np.concatenate(parts, axis=-1) for parts in zip(*rows, strict=True)))
        learned[g] = []
    total = np.zeros(len(keys))
    for on, bit, gate, x in asked:
        for g, part in by_shard(gate):
            total[on[part]] += _loss(gates[g].refined(gates[g].mixed(x[:, part]).astype(np.float64)), bit[part] == 1)
    return total


#: Bytes of context that a text's own places are counted by, and what the model's probability weighs beside them.
OWN_ORDER, MODEL_WEIGHT = 6, 10.0


def adapted(keys: np.ndarray, owner: np.ndarray, loss: np.ndarray) -> np.ndarray:
    """The losses of texts' places in order, refined as the texts go on.

    With n earlier places of the text after the same six bytes, m of them with the same own byte, a probability p becomes (m + w p) / (n + w):
    what a text repeats grows likelier in it. The probabilities of a context still add up to one.
    """
    text = mix(owner.astype(np.uint64) + np.uint64(1))
    n, m = (_earlier(mix(of + text)) for of in (context(keys, OWN_ORDER), keys | np.uint64(1 << 63)))
    return -np.log((m + MODEL_WEIGHT * np.exp(-loss)) / (n + MODEL_WEIGHT))


def _earlier(names: np.ndarray) -> np.ndarray:
    """For each name (a hash of which 44 bits count) how often it occurred before; 2**20 names at most."""
    spot = np.uint64((1 << 20) - 1)
    order = names & ~spot | np.arange(len(names), dtype=np.uint64)
    order.sort()
    first = _starts(order >> np.uint64(20))
    found = np.empty(len(names), dtype=np.int64)
    found[(order & spot).astype(np.int64)] = np.arange(len(names)) - np.repeat(first, np.diff(np.append(first, len(names))))
    return found


class Found:
    """The place of numbers among sorted distinct ones, by hash first."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, bits = keys, max(4, int(np.ceil(np.log2(max(1, len(keys))))) + 2)
        self.shift, self.slots = np.uint64(64 - bits), np.zeros(1 << bits, dtype=np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(_BASE) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(keys)]
        missed = np.flatnonzero(self.keys[at] != keys)
        at[missed] = np.searchsorted(self.keys, keys[missed])
        return at
