"""Parents that are too large for one, split into parts.

The standard split keeps each part's own windows within the band that a parent may have: elements that are huge, or
have too many windows alone, are cut at seams first, the rest is cut where the windows of the whole say, and every part
is counted anew by its own windows and bisected until it fits. The legacy split goes by characters, at preferred places
under a soft or a hard cap. A block is one row of a task; blocks run in parallel."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .chunking import CHILD_CHARS, CHILDREN, OVERLAP_MAX, PARENT_TOKENS, SEAM_REACH, sentence_seams, window_spans, windows

# Where a part is closed, and the caps of the legacy split.
CLOSE_TOKENS, SOFT_CHARS, HARD_CHARS = 1344, 7500, 20_000
#: Blocks whose texts a task has open at once.
BLOCKS = 128
#: What an element that says something has: any character but these, as in the SQL of part_audit.
SAID = r"[^ \t\n\r\f\x0B\x1c-\x1f\x85\xa0]"


def tokens(chars: int) -> int:
    return max(1, chars // 4) if chars else 0


def is_seam(text: str, at: int) -> bool:
    """Whether a sentence or a word ends before the place."""
    if not 0 < at < len(text):
        return True
    before = text[at - 1]
    return before in " \t\n" or (before in ".!?;" and text[at] in " \n")


def seam_before(text: str, end: int, at: int) -> int:
    """The last seam behind ``at`` and within OVERLAP_MAX characters before ``end``, or that if there is none."""
    return next((p for p in range(end, max(at, end - OVERLAP_MAX) - 1, -1) if p > at and is_seam(text, p)), end)


def seam_cuts(text: str, most: int = CLOSE_TOKENS) -> list[tuple[int, int]]:
    """Slices of at most ``most`` tokens, each but the last cut at the last seam within OVERLAP_MAX characters
    before that, or there if there is none."""
    out, at, reach = [], 0, 4 * most + 3
    while len(text) - at > reach:
        seam = seam_before(text, at + reach, at)
        out.append((at, seam))
        at = seam
    return [*out, (at, len(text))]


def unit_cuts(text: str, most: int = CHILDREN[1], close: int = CLOSE_TOKENS) -> list[tuple[int, int]]:
    """seam_cuts, of which each that has over ``most`` windows alone is halved at the last seam before its middle window
    until none has."""
    out, todo = [], seam_cuts(text, close)[::-1]
    while todo:
        a, z = todo.pop()
        # a window begins at least so far behind the one before
        spans = windows(text[a:z]) if z - a > most * (CHILD_CHARS - OVERLAP_MAX - SEAM_REACH) else []
        if len(spans) <= most:
            out.append((a, z))
            continue
        cut = seam_before(text, a + spans[len(spans) // 2][0], a)
        todo += [(cut, z), (a, cut)]  # the left one comes next
    return out


class Stream:
    """Units joined by blank lines: where each starts, and the windows of any run of them."""

    def __init__(self, texts: list[str], atomic: list[bool]):
        self.starts, at = [], 0
        for t in texts:
            self.starts.append(at)
            at += len(t) + 2
        self.ends = [a + len(t) for a, t in zip(self.starts, texts)]
        self.text, self.atomic = "\n\n".join(texts), atomic
        self.seams = sentence_seams(self.text)

    def chars(self, i: int, j: int) -> int:
        return self.ends[j - 1] - self.starts[i]

    def windows(self, i: int, j: int) -> list[tuple[int, int]]:
        atoms = [(self.starts[u], self.ends[u]) for u in range(i, j) if self.atomic[u]]
        return window_spans(self.starts[i], self.ends[j - 1], self.starts[i + 1 : j], self.seams, atoms)

    def bisected(self, i: int, j: int, most: int) -> list[tuple[int, int]]:
        """i..j, halved at the unit nearest behind its middle window until each run has at most ``most`` windows
        and PARENT_TOKENS tokens or is one unit."""
        out, todo = [], [(i, j)]
        while todo:
            i, j = todo.pop()
            spans = self.windows(i, j) if j - i > 1 else []
            if len(spans) <= most and (j - i == 1 or tokens(self.chars(i, j)) <= PARENT_TOKENS):
                out.append((i, j))
                continue
            middle = bisect_left(self.starts, spans[len(spans) // 2][0], i, j)
            cut = min(max(middle, i + 1), j - 1)
            todo += [(cut, j), (i, cut)]  # the left one comes next
        return out


def standard_runs(texts: list[str], atomic: list[bool], most: int = CHILDREN[1], close: int = CLOSE_TOKENS) -> list[tuple[int, int]]:
    """The runs of units that are parts: one if all of them fit, else cut where each part's share of the windows
    of the whole begins; a last one of under half the closing size joins the one before if that still fits."""
    stream, n = Stream(texts, atomic), len(texts)
    if tokens(stream.chars(0, n)) <= close:
        return stream.bisected(0, n, most)
    windows = stream.windows(0, n)
    wanted = max(2, -(-len(windows) // most))
    shares = [windows[len(windows) * p // wanted][0] for p in range(1, wanted)]
    cuts = sorted({0, n, *(c for c in (bisect_left(stream.starts, at) for at in shares) if c < n)})
    runs = list(zip(cuts, cuts[1:]))
    while len(runs) > 1:
        (a, _), (c, z) = runs[-2:]
        if tokens(stream.chars(c, z)) >= close // 2 or tokens(stream.chars(a, z)) > close:
            break
        runs[-2:] = [(a, z)]
    return [r for i, j in runs for r in stream.bisected(i, j, most)]


def legacy_runs(sizes: list[int], preferred: list[bool], soft: bool = False, soft_cap: int = SOFT_CHARS, hard_cap: int = HARD_CHARS) -> list[tuple[int, int]]:
    """Runs of elements, joined by two characters each, within the cap (the smaller one if soft): where one would
    be passed, the run ends at the last preferred start in it, else there; what lies behind that start counts for
    the next run. An element over the cap is a run alone. If soft, a last run of under half the cap joins the one
    before it as long as the hard cap allows."""
    cap = min(soft_cap, hard_cap) if soft else hard_cap
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s + 2)
    chars = lambda i, j: ends[j] - ends[i] - 2
    starts = [i for i, p in enumerate(preferred) if p]
    runs, start = [], 0
    for i in range(len(sizes)):
        while i > start and chars(start, i + 1) > cap:
            at = bisect_left(starts, i + 1) - 1
            cut = starts[at] if at >= 0 and starts[at] > start else i
            runs.append((start, cut))
            start = cut
    runs.append((start, len(sizes)))
    while soft and len(runs) > 1:
        (a, _), (c, z) = runs[-2:]
        if chars(c, z) >= cap // 2 or chars(a, z) > hard_cap:
            break
        runs[-2:] = [(a, z)]
    return runs


def _blocks(elements: DataFrame, keys: list[str], order: str, text: str, blank: bool, **flags: Column | None) -> DataFrame:
    """keys and es, the elements (those that say something, unless blank) of a block in order."""
    rows = elements if blank else elements.where(F.col(text).rlike(SAID))
    marks = [F.coalesce(c, F.lit(False)).alias(n) if c is not None else F.lit(False).alias(n) for n, c in flags.items()]
    one = F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"), *marks)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("es"))


def standard_parts(elements: DataFrame, keys: list[str], order: str, text: str = "text", atomic: Column | None = None) -> DataFrame:
    """keys, part (from 1), part_count, first, first_char, last, last_char, n_units, text, children: the parts of
    every block (keys) of elements, by standard_runs.

    A part goes from the character first_char of its first element up to last_char of its last one; only elements that
    are not atomic and have over CLOSE_TOKENS, or more windows than a part may have, are cut (unit_cuts). children are
    the windows (start, end) over the part's text."""
    kinds = {f.name: f.dataType.simpleString() for f in elements.schema.fields}
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    schema = f"{named}, part int, part_count int, first {kinds[order]}, first_char long, last {kinds[order]}, last_char long, n_units long, text string, children array<struct<start:long,end:long>>"
    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(schema).fields]
    names = [*keys, "part", "part_count", "first", "first_char", "last", "last_char", "n_units", "text", "children"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCKS):  # texts are opened a few at a time
                own, rows = b.slice(at, BLOCKS), []
                for r, es in enumerate(own.column(len(keys)).to_pylist()):
                    units = []  # (order, first character, text, atomic)
                    for e in es:
                        cuts = [(0, len(e["t"]))] if e["alone"] else unit_cuts(e["t"])
                        units += [(e["o"], a, e["t"][a:z], e["alone"]) for a, z in cuts]
                    runs = standard_runs([u[2] for u in units], [u[3] for u in units])
                    for p, (i, j) in enumerate(runs, 1):
                        stream = Stream([u[2] for u in units[i:j]], [u[3] for u in units[i:j]])
                        spans = [{"start": a, "end": z} for a, z in stream.windows(0, j - i)]
                        last = units[j - 1]
                        rows.append((r, p, len(runs), units[i][0], units[i][1], last[0], last[1] + len(last[2]), j - i, stream.text, spans))
                columns = list(zip(*rows)) if rows else [[]] * (len(names) - len(keys) + 1)
                of = pa.array(columns[0], pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(of) for c in own.columns[: len(keys)]), *(pa.array(c, t) for c, t in zip(columns[1:], types[len(keys) :]))], names)

    return _blocks(elements, keys, order, text, False, alone=atomic).mapInArrow(run, schema)


def legacy_parts(elements: DataFrame, keys: list[str], order: str, text: str = "text", preferred: Column | None = None, soft: bool = False, soft_cap: int = SOFT_CHARS, hard_cap: int = HARD_CHARS) -> DataFrame:
    """keys, part (from 1), part_count, first, last (order), n_elements, n_chars of the parts of every block, by
    legacy_runs. preferred: whether an element is a good place to start a part, such as a JSON container
    (json_container_starts) or the start of a paragraph run."""
    kinds = {f.name: f.dataType.simpleString() for f in elements.schema.fields}
    columns = [*keys, "part", "part_count", "first", "last", "n_elements", "n_chars"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for own, es in zip(f[keys].itertuples(index=False), f["es"]):
                runs = legacy_runs([e["n"] for e in es], [e["good"] for e in es], soft, soft_cap, hard_cap)
                rows += [(*own, p, len(runs), es[i]["o"], es[j - 1]["o"], j - i, sum(e["n"] + 2 for e in es[i:j]) - 2) for p, (i, j) in enumerate(runs, 1)]
            yield pd.DataFrame(rows, columns=columns)

    # only sizes pass: the texts stay where they are
    one = F.struct(F.col(order).alias("o"), F.coalesce(F.length(text), F.lit(0)).alias("n"), (F.coalesce(preferred, F.lit(False)) if preferred is not None else F.lit(False)).alias("good"))
    sized = elements.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("es"))
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", part int, part_count int, first {kinds[order]}, last {kinds[order]}, n_elements long, n_chars long"
    return sized.mapInPandas(run, schema)


def json_container_starts(leaves: DataFrame, keys: list[str], order: str, path: str = "path", name: str = "preferred") -> DataFrame:
    """leaves with a flag for those whose container (the path without its last name) is not that of the leaf before."""
    container = F.regexp_replace(path, r"\.[^.\[\]]+$", "")
    w = Window.partitionBy(*keys).orderBy(order)
    return leaves.withColumn("_own", container).withColumn(name, F.coalesce(F.col("_own") != F.lag("_own").over(w), F.lit(False))).drop("_own")
