"""Benchmark decontamination: every passage of every text is a query to a BM25 index of the test items.

The index is inverted: a term's postings are items in order, cut into blocks that carry the block's greatest
contribution. A contribution is the item's BM25 weight of the term over the item's own full score, so one threshold
holds for all items and is reached only by passages that cover that share of an item. Passages are overlapping windows
twice as long as the longest item, so any copy lies whole in one of them.

A batch first bounds all its passages at once: the block maxima of the terms present, plus the most that frequent terms
could add to an item. Passages whose bound reaches the threshold in some block run block-max WAND: pivot by term
bounds, block bounds at the pivot, full scores only where those reach the threshold. All items above it are retrieved;
a hit is verified by the share of the question's and of the answer's three-word runs that the passage holds. An item's
answer is its last sentence (its last third if it has one sentence only), the question all before.

Items are indexed in groups of at most ``MAX_INDEX_BYTES`` of text, each broadcast and run over all texts, with document
frequencies over all items; the usual benchmark is one group. No text is shuffled and nothing is collected from texts.

Tokens are runs of letters and digits; a character of a script without blanks between words is a token by itself. Of an
item of fewer than ``MIN_WORDS`` tokens the passage must hold all of them as one run.

Defined results: null or empty texts and items match nothing; an item of one or two tokens is not searched for, as any
text may hold it; repeated items are separate items; repeated rows give a row each; an empty table gives an empty result; extra
columns are ignored (``scan``) or kept (``remove``).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import flat, mix, portions, range_hashes, small_batches, stage, tidy

K1, B = 1.5, 0.75
THRESHOLD, OVERLAP, RUN, MIN_WORDS = 0.5, 0.5, 3, 8
BLOCK = 4
COMMON_SHARE = 0.2
MAX_INDEX_BYTES = 16 << 20

_SOLID = np.zeros(256, bool)
_SOLID[48:58] = _SOLID[97:123] = _SOLID[128:] = True


def _at(buf: np.ndarray, lead: int, low: int, high: int) -> np.ndarray:
    """Places of a first byte whose next byte lies in low..high."""
    at = np.flatnonzero(buf[:-1] == lead)
    return at[(buf[at + 1] >= low) & (buf[at + 1] <= high)]


def _token_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, tokens before each row): runs of letters and digits of lower-cased rows. A character of a script
    that is written without blanks is a token by itself; general and ideographic punctuation parts tokens."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = _SOLID[buf]
    part = np.zeros(len(buf) + 1, bool)
    part[off] = True
    if buf.max() >= 0xE0:
        for lead, low, high in ((0xE2, 0x80, 0x80), (0xE3, 0x80, 0x80), (0xEF, 0xBC, 0xBC)):
            at = _at(buf, lead, low, high)
            if lead == 0xEF:  # the full-width forms of signs, not those of digits and letters
                at = at[(at + 2 < len(buf)) & (buf[np.minimum(at + 2, len(buf) - 1)] <= 0x8F)]
            for k in range(3):
                solid[np.minimum(at + k, len(buf) - 1)] = False
        alone = [_at(buf, 0xE3, 0x81, 0xBF), np.flatnonzero((buf >= 0xE4) & (buf <= 0xE9)), _at(buf, 0xE0, 0xB8, 0xBB), _at(buf, 0xE1, 0x80, 0x82), _at(buf, 0xE1, 0x9E, 0x9F)]
        for at in alone:
            part[at] = part[np.minimum(at + 3, len(buf))] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | part[1:-1]
    last[:-1] &= ~solid[1:] | part[1:-1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.lower().encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def _terms(buf: np.ndarray, off: np.ndarray):
    """(start, end, fingerprint, tokens before each row)."""
    start, end, first = _token_spans(buf, off)
    return start, end, range_hashes(buf, start, end, 23), first


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all runs of ``n`` tokens."""
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)] + np.uint64(k + 1))
    return out


def answer_at(text: str) -> int:
    """Where the last sentence begins (as bytes of the lower-cased text), or -1 if there is one only."""
    low = text.lower().rstrip()
    found = None
    for found in re.finditer(r"(?<=[.?!])\s+|(?<=[。？！])\s*(?=\S)", low):
        pass
    return len(low[: found.end()].encode()) if found and low[: found.start()].strip() else -1


class _Lists:
    """Slices of one array."""

    def __init__(self, values: np.ndarray, start: np.ndarray):
        self.values, self.start = values, start

    def __getitem__(self, i: int) -> np.ndarray:
        return self.values[self.start[i] : self.start[i + 1]]


class Index:
    """Postings with block maxima over a group of items; frequencies may come from all items (``df``: sorted term
    fingerprints and their counts). All of it is flat arrays, linear in the items' text."""

    def __init__(self, items: list[tuple], df: tuple[np.ndarray, np.ndarray] | None = None, n_items: int | None = None, mean: float | None = None, threshold: float = THRESHOLD):
        buf, off = _joined([t or "" for _, t in items])
        start, _, h, first = _terms(buf, off)
        size = np.diff(first)
        use = size >= RUN
        own = np.flatnonzero(use)
        self.ids = [items[i][0] for i in own]
        self.threshold = threshold
        self.length = int(size[own].max(initial=1))
        self._parts(h, start, first, off, own, [items[i][1] for i in own])
        rank = np.cumsum(use) - 1
        row = np.repeat(np.arange(len(size)), size)
        inside = use[row]
        h, item = h[inside], rank[row[inside]]
        self.keys, term = np.unique(h, return_inverse=True)
        n_terms, n = len(self.keys), len(own)
        pair, count = np.unique(term * max(n, 1) + item, return_counts=True)
        term, item = pair // max(n, 1), pair % max(n, 1)
        if df is None:
            often = np.bincount(term, minlength=n_terms)
        else:
            at = np.minimum(np.searchsorted(df[0], self.keys), len(df[0]) - 1)
            often = np.where(df[0][at] == self.keys, df[1][at], 1)
        n_items = n_items or n
        mean = mean or (float(size[own].mean()) if n else 1.0)
        idf = np.log(1 + (n_items - often + 0.5) / (often + 0.5))
        weight = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * size[own][item] / mean))
        weight /= np.bincount(item, weight, n)[item]
        begin = np.searchsorted(term, np.arange(n_terms + 1))
        self.items, self.weights = _Lists(item.astype(np.int32), begin), _Lists(weight, begin)
        self.begin = begin
        self.bound = np.maximum.reduceat(weight, begin[:-1]) if n_terms else np.zeros(0)
        # a term's blocks and their maxima, one after the other
        self.n_blocks = max(1, -(-n // BLOCK))
        cell = term * self.n_blocks + item // BLOCK
        at = np.flatnonzero(np.diff(cell, prepend=-1))
        self.block_keys = cell[at]
        self.block_max = np.maximum.reduceat(weight, at) if len(at) else np.zeros(0)
        self.block_start = np.searchsorted(self.block_keys, np.arange(n_terms + 1) * self.n_blocks)
        # frequent terms whose weights together stay under COMMON_SHARE of any item are left out of the first bound
        rest = np.zeros(n)
        self.common = np.zeros(n_terms, bool)
        for j in np.argsort(-np.diff(begin), kind="stable"):
            rest[self.items[j]] += self.weights[j]
            if rest.max() > COMMON_SHARE:
                rest[self.items[j]] -= self.weights[j]
                break
            self.common[j] = True
        self.slack = float(rest.max(initial=0.0))
        self.block_slack = np.maximum.reduceat(rest, np.arange(0, n, BLOCK)) if n else np.zeros(1)

    def _parts(self, h: np.ndarray, start: np.ndarray, first: np.ndarray, off: np.ndarray, own: np.ndarray, texts: list[str]) -> None:
        """Run lengths and distinct runs of each item's question and answer; of a short item all its tokens as one run."""
        lengths, runs = [], []
        for i, text in zip(own, texts, strict=True):
            a, z = int(first[i]), int(first[i + 1])
            at = answer_at(text)
            cut = a + int(np.searchsorted(start[a:z] - off[i], at)) if at >= 0 else z
            cut = cut if a < cut < z else a + -(-2 * (z - a) // 3)
            spans = [(a, cut, RUN), (cut, z, RUN)] if z - a >= MIN_WORDS else [(a, z, MIN_WORDS), (z, z, 1)]
            for x, y, most in spans:
                n = min(most, y - x)
                lengths.append(n)
                runs.append(np.unique(_runs(h[x:y], n)) if n else np.zeros(0, np.uint64))
        self.run_length = np.array(lengths, np.int8)
        self.runs = _Lists(np.concatenate(runs) if runs else np.zeros(0, np.uint64), np.cumsum([0, *map(len, runs)]))

    def overlaps(self, item: int, passage: dict[int, np.ndarray], h: np.ndarray) -> list[float]:
        """The share of the question's and of the answer's runs that a passage of tokens ``h`` holds."""
        out = []
        for part in (2 * item, 2 * item + 1):
            want, n = self.runs[part], int(self.run_length[part])
            if n and n not in passage:
                passage[n] = np.unique(_runs(h, n))
            out.append(float(np.isin(want, passage[n], assume_unique=True).mean()) if len(want) else 1.0)
        return out

    def _block_bounds(self, terms: list[int], block: int) -> float:
        key = np.array(terms) * self.n_blocks + block
        at = np.searchsorted(self.block_keys, key)
        at[at == len(self.block_keys)] = 0
        return float(self.block_max[at[self.block_keys[at] == key]].sum())

    def wand(self, present: np.ndarray, first: int = 0, end: int | None = None) -> list[tuple[int, float]]:
        """All items (from first, before end) whose score by the present terms reaches the threshold."""
        need = self.threshold - 1e-9
        end = len(self.ids) if end is None else end
        cur = []
        for t in present:
            own = self.items[t]
            at = int(np.searchsorted(own, first))
            if at < len(own) and own[at] < end:
                cur.append([int(own[at]), at, int(t)])
        found = []
        while cur:
            cur.sort()
            total, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cur):
                total += self.bound[t]
                if total >= need:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cur[pivot][0]
            while pivot + 1 < len(cur) and cur[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if self._block_bounds([t for _, _, t in cur[: pivot + 1]], block) >= need:
                if cur[0][0] == item:
                    score = sum(self.weights[t][at] for i, at, t in cur[: pivot + 1] if i == item)
                    if score >= need:
                        found.append((item, float(score)))
                    target = item + 1
                else:
                    target = item
            else:  # nothing in this block up to the next list's item
                target = (block + 1) * BLOCK
                if pivot + 1 < len(cur):
                    target = min(target, cur[pivot + 1][0])
                target = max(target, item + 1)
            moved = []
            for i, at, t in cur:
                if i < target:
                    own = self.items[t]
                    at += int(np.searchsorted(own[at:], target))
                    if at >= len(own):
                        continue
                    i = int(own[at])
                    if i >= end:
                        continue
                moved.append([i, at, t])
            cur = moved
        return found

    def search(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, float, float, float, int]]:
        """(row, item, score, question overlap, answer overlap, passages) for lower-cased texts, best passage first."""
        if not len(self.ids) or not len(buf):
            return []
        start, _, h, first = _terms(buf, off)
        if not len(start):
            return []
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == h
        place = np.flatnonzero(hit)
        term = at[place]
        row = np.searchsorted(first, place, "right") - 1
        step = self.length
        inside = (place - first[row]) // step
        count = np.maximum(1, -(-np.diff(first) // step))
        base = np.concatenate([[0], np.cumsum(count)])
        # a passage is two steps long: a word lies in the one that begins at its step and in the one before
        now = base[row] + inside
        rare = ~self.common[term]
        window = np.concatenate([now[rare], (now - 1)[rare & (inside > 0)]])
        terms = np.concatenate([term[rare], term[rare & (inside > 0)]])
        key = np.unique(window * len(self.bound) + terms)
        window, terms = key // len(self.bound), key % len(self.bound)
        lone = np.add.reduceat(self.bound[terms], cut := np.flatnonzero(np.diff(window, prepend=-1))) if len(key) else np.zeros(0)
        live = np.flatnonzero(lone + self.slack >= self.threshold - 1e-6) if len(key) else []
        out: dict[tuple[int, int], list] = {}
        # block bounds of the passages that are left: the blocks of their terms, added up
        pair = np.repeat(np.isin(np.arange(len(cut)), live), np.diff(np.append(cut, len(key)))) if len(key) else np.zeros(0, bool)
        window, terms = window[pair], terms[pair]
        many = self.block_start[terms + 1] - self.block_start[terms]
        for i, j in portions(np.concatenate([[0], np.cumsum(many)])[np.flatnonzero(np.diff(window, prepend=-1, append=-1))]) if len(window) else ():
            cut = np.flatnonzero(np.diff(window, prepend=-1, append=-1))
            own = slice(cut[i], cut[j])  # whole passages, so that work arrays stay bounded
            for w, block in self._cells(window[own], terms[own], many[own]):
                r = int(np.searchsorted(base, w, "right")) - 1
                lo = int(first[r]) + (w - int(base[r])) * step
                hi = min(lo + 2 * step, int(first[r + 1]))
                x, y = np.searchsorted(place, [lo, hi])
                passage: dict[int, np.ndarray] = {}
                for item, score in self.wand(np.unique(term[x:y]), block * BLOCK, (block + 1) * BLOCK):
                    over = self.overlaps(item, passage, h[lo:hi])
                    short = int(self.run_length[2 * item + 1]) == 0
                    if min(over) >= (1.0 if short else OVERLAP):
                        best = out.setdefault((r, item), [score, *over, 0])
                        best[:3] = max(best[:3], [score, *over])
                        best[3] += 1
        return [(r, item, *v) for (r, item), v in sorted(out.items())]

    def _cells(self, window: np.ndarray, terms: np.ndarray, many: np.ndarray):
        """(passage, block) whose block bounds, added up over the passage's terms, reach the threshold."""
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.block_start[terms], many)
        cell, which = np.unique(np.repeat(window, many) * self.n_blocks + self.block_keys[at] % self.n_blocks, return_inverse=True)
        bound = np.bincount(which, self.block_max[at], len(cell)) + self.block_slack[cell % self.n_blocks]
        for c in cell[bound >= self.threshold - 1e-6].tolist():
            yield divmod(c, self.n_blocks)


def _distinct_terms(batches):
    for batch in batches:
        buf, off = flat(batch.column(0))
        _, _, h, first = _terms(buf, off)
        size = np.diff(first)
        row = np.repeat(np.arange(len(size)), size)
        keep = np.flatnonzero((size >= RUN)[row])
        pair = np.unique(np.stack([row[keep].astype(np.uint64), h[keep]]), axis=1) if len(keep) else np.zeros((2, 0), np.uint64)
        first_of = np.searchsorted(pair[0], np.arange(len(size)).astype(np.uint64))
        # the number of tokens goes with an item's first term
        tokens = np.zeros(pair.shape[1], np.int64)
        tokens[first_of[size >= RUN]] = size[size >= RUN]
        yield pa.RecordBatch.from_arrays([pa.array(pair[1].view(np.int64)), pa.array(tokens)], names=["t", "tokens"])


def build(items: DataFrame, text: str = "text", threshold: float = THRESHOLD, most: int = MAX_INDEX_BYTES) -> list[Index]:
    """Indexes over groups of items, each of at most about ``most`` bytes of text."""
    slim = items.select("item_id", F.col(text).alias("text")).where(F.col("text").isNotNull())
    total = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if total <= most:
        return [Index([tuple(r) for r in slim.orderBy("item_id", "text").collect()], threshold=threshold)]
    small_batches(items.sparkSession)
    word = stage(slim.select(F.lower("text")).mapInArrow(lambda it: tidy(_distinct_terms(it)), "t long, tokens long"), "item-terms")
    n, tokens = word.agg(F.count_if(F.col("tokens") > 0), F.sum("tokens")).first()
    df = word.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    groups = -(-total // (most // 2))
    out = []
    for g in range(groups):
        mine = slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        own = mine.select(F.lower("text")).mapInArrow(lambda it: tidy(_distinct_terms(it)), "t long, tokens long").select("t").distinct().join(df, "t").toArrow()
        key, often = own.column("t").to_numpy().view(np.uint64), own.column("df").to_numpy()
        order = np.argsort(key)
        out.append(Index([tuple(r) for r in mine.orderBy("item_id", "text").collect()], (key[order], often[order]), n, tokens / max(n, 1), threshold))
    return out


def _found(index: Index, text: pa.Array) -> list[tuple]:
    buf, off = flat(text)
    return [(i + r, *rest) for i, j in portions(off) for r, *rest in index.search(buf[off[i] : off[j]], off[i : j + 1] - off[i])]


def _scan(batches, index: Index):
    for batch in batches:
        got = _found(index, batch.column(1))
        rows, items, *rest = zip(*got, strict=True) if got else ((), (), (), (), (), ())
        kinds = [pa.float64()] * 3 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([index.ids[k] for k in items], pa.int64()), *[pa.array(x, k) for x, k in zip(rest, kinds, strict=True)]], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "n_passages"])


def scan(docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row a document and test item it holds: doc_id, item_id, score, question_overlap, answer_overlap, n_passages."""
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text).alias("text"))
    out = None
    for index in build(items, threshold=threshold):
        shared = spark.sparkContext.broadcast(index)

        def task(batches, shared=shared):
            yield from tidy(_scan(batches, shared.value))

        part = slim.mapInArrow(task, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, n_passages long")
        out = part if out is None else out.unionByName(part)
    return out


def _keep(batches, index: Index, at: int):
    import pyarrow.compute as pc

    for batch in batches:
        bad = np.ones(batch.num_rows, bool)
        bad[[r for r, *_ in _found(index, pc.utf8_lower(batch.column(at)))]] = False
        yield batch.filter(pa.array(bad))


def remove(docs: DataFrame, items: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that hold a test item; nothing is joined or shuffled."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index(text)
    for index in build(items, threshold=threshold):
        shared = spark.sparkContext.broadcast(index)

        def task(batches, shared=shared):
            yield from tidy(_keep(batches, shared.value, at))

        docs = docs.mapInArrow(task, docs.schema)
    return docs
