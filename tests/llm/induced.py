"""The dealt method of operator 10 in small: suffix sorting by external induced sorting, one shard.

Priority queues hold (character, rank of the next suffix, position) and spill sorted runs to disk
beyond a bound; equal names of sampled suffixes recurse.  Used as an independent check of the
operator, and to measure what the method costs (``python -m tests.llm.induced``).
"""

import heapq
import pickle
import tempfile


class DiskQueue:
    """A priority queue that keeps at most ``bound`` entries in memory and the rest in sorted runs."""

    def __init__(self, bound=1 << 16):
        self.bound, self.heap, self.runs, self.fronts, self.spilled = bound, [], [], [], 0

    def push(self, entry):
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.bound:
            run = tempfile.TemporaryFile()
            for e in sorted(self.heap):
                pickle.dump(e, run)
            self.spilled += run.tell()
            run.seek(0)
            self.heap = []
            self.runs.append(run)
            heapq.heappush(self.fronts, (pickle.load(run), len(self.runs) - 1))

    def _head(self):
        if self.heap and (not self.fronts or self.heap[0] <= self.fronts[0][0]):
            return self.heap[0]
        return self.fronts[0][0] if self.fronts else None

    def peek(self):
        return self._head()

    def pop(self):
        if self.heap and (not self.fronts or self.heap[0] <= self.fronts[0][0]):
            return heapq.heappop(self.heap)
        entry, run = self.fronts[0]
        try:
            heapq.heapreplace(self.fronts, (pickle.load(self.runs[run]), run))
        except EOFError:
            heapq.heappop(self.fronts)
        return entry


def suffix_array(s, bound=1 << 16, stats=None):
    """Positions of all suffixes of a sequence of non-negative numbers, in order."""
    n = len(s)
    if n < 2:
        return list(range(n))
    is_s = [False] * (n + 1)
    is_s[n] = True
    for i in range(n - 2, -1, -1):
        is_s[i] = s[i] < s[i + 1] or (s[i] == s[i + 1] and is_s[i + 1])
    sampled = [i for i in range(1, n) if is_s[i] and not is_s[i - 1]]
    ends = sampled[1:] + [n - 1]
    # of two pieces of which one begins the other the longer is smaller, unless the text's end cut it
    pieces = {i: (*s[i:e + 1], -1 if i == sampled[-1] else float("inf")) for i, e in zip(sampled, ends)}
    queue = DiskQueue(bound)
    for i in sampled:
        queue.push((pieces[i], i))
    names, previous, name = {}, None, -1
    for _ in sampled:
        piece, i = queue.pop()
        if piece != previous:
            name, previous = name + 1, piece
        names[i] = name
    reduced = [names[i] for i in sampled]
    if name + 1 < len(sampled):
        order = [sampled[k] for k in suffix_array(reduced, bound, stats)]
    else:
        order = sorted(sampled, key=names.get)
    # L suffixes, ascending: the last suffix and the predecessors of what has been sorted
    left, seeds, rank = DiskQueue(bound), iter([*order, None]), 0
    left.push((s[n - 1], -1, n - 1))
    seed, found_l = next(seeds), []
    while left.peek() is not None or seed is not None:
        if left.peek() is not None and (seed is None or left.peek()[0] <= s[seed]):
            i = left.pop()[2]
            found_l.append(i)
        else:
            i, seed = seed, next(seeds)
        if i and not is_s[i - 1]:
            left.push((s[i - 1], rank, i - 1))
        rank += 1
    # S suffixes, descending, from the L suffixes
    right, rank, out, k = DiskQueue(bound), 0, [], len(found_l) - 1
    while right.peek() is not None or k >= 0:
        if right.peek() is not None and (k < 0 or -right.peek()[0] >= s[found_l[k]]):
            i = right.pop()[2]
        else:
            i, k = found_l[k], k - 1
        out.append(i)
        if i and is_s[i - 1]:
            right.push((-s[i - 1], rank, i - 1))
        rank += 1
    if stats is not None:
        stats["spilled"] = stats.get("spilled", 0) + queue.spilled + left.spilled + right.spilled
        stats["entries"] = stats.get("entries", 0) + len(sampled) + n
    return out[::-1]


def common_prefixes(s, order):
    """Length of the common prefix of each suffix in order with the one before."""
    place, out, h = {p: k for k, p in enumerate(order)}, [0] * len(order), 0
    for i in range(len(s)):
        if place[i]:
            j = order[place[i] - 1]
            while i + h < len(s) and j + h < len(s) and s[i + h] == s[j + h]:
                h += 1
            out[place[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out


if __name__ == "__main__":
    import glob
    import time

    import pyarrow.dataset as ds

    texts = ds.dataset(glob.glob("/root/testdata/sf0.1/documents.parquet")).to_table(columns=["text"]).slice(0, 300)
    data = "\0".join(texts.column(0).to_pylist()).encode()[:1_000_000]
    stats, began = {}, time.process_time()
    suffix_array(data, 1 << 14, stats)
    spent = time.process_time() - began
    print(f"{len(data)} bytes: {spent / len(data) * 1e6:.1f} CPU microseconds a byte, {stats['entries'] / len(data):.2f} queue entries a byte, "
          f"{stats['spilled'] / len(data):.0f} bytes spilled a byte")
