"""Chunking: blocks of consecutive elements, sliding windows, tabular parents, who owns a window, small
elements folded, texts capped, section paths, and summaries of locations."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import islands, numbered, pack

# The default sizes.
CHILD_TOKENS, CHILD_CHARS, OVERLAP_MIN, OVERLAP_MAX, OVERLAP, SEAM_REACH = 250, 1000, 200, 300, 250, 200
CHILDREN, PARENT_TOKENS = (4, 8), 1800
GROUP_CHARS = 6264
TRUNCATED = "\n…[truncated]"


def blocks(elements: DataFrame, doc: str, order: str, key: Column, name: str = "block") -> DataFrame:
    """Numbers the maximal runs of consecutive elements with an equal key, from 1 in each document."""
    return islands(elements.withColumn("_key", key), [doc], [order], "_key", name).drop("_key")


def paragraph_runs(lines: DataFrame, doc: str = "doc_id", first: str = "line_number", last: str | None = None, order: str | None = None) -> DataFrame:
    """Numbers (column run, from 1) runs of elements between gaps of two or more line numbers.

    first and last: an element's lines; one without any has the last line before it."""
    end = F.coalesce(F.col(last), F.col(first)) if last else F.col(first)
    w = Window.partitionBy(doc).orderBy(order or first)
    before = F.last(end, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.coalesce(F.col(first) - before >= 2, F.lit(False))
    marked = lines.withColumn("_new", F.when(gap | (F.row_number().over(w) == 1), 1).otherwise(0))
    return marked.withColumn("run", F.sum("_new").over(w).cast("long")).drop("_new")


def paragraph_groups(lines: DataFrame, doc: str = "doc_id", first: str = "line_number", last: str | None = None, order: str | None = None, text: str = "text", target: int = GROUP_CHARS) -> DataFrame:
    """doc, group (from 0), n_runs, n_elements, n_chars, line_first, line_last, first, last (order): runs of elements
    put together in order until ``target`` characters would be passed, each run whole, joins by a blank line counted.

    Only the sizes of runs are packed, by ranges; a run that is longer than the target is a group alone, one
    without a character in none."""
    order = order or first
    runs = paragraph_runs(lines.select(doc, *dict.fromkeys([first, *([last] if last else []), order, text])), doc, first, last, order)
    end = F.coalesce(F.col(last), F.col(first)) if last else F.col(first)
    joins = 2 * (F.count(F.lit(1)) - 1)
    per = runs.groupBy(doc, "run").agg(
        (F.coalesce(F.sum(F.length(text)), F.lit(0)) + joins).alias("_size"), F.count(F.lit(1)).alias("_n"), F.min(first).alias("_low"), F.max(end).alias("_high"), F.min(order).alias("_a"), F.max(order).alias("_z"),
    )
    packed = pack(per, doc, "run", "_size", target).where("group is not null")
    return packed.groupBy(doc, "group").agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum("_n").alias("n_elements"), (F.sum("_size") + joins).alias("n_chars"),
        F.min("_low").alias("line_first"), F.max("_high").alias("line_last"), F.min("_a").alias("first"), F.max("_z").alias("last"),
    )


SENTENCE_END = re.compile(r"\n|[.!?;](?=[ \n])")


def sentence_seams(stream: str) -> list[int]:
    """Places after a newline, and after ``. ! ? ;`` before a space or newline; the end of the text is none."""
    return [m.end() for m in SENTENCE_END.finditer(stream) if m.end() < len(stream)]


def _last(seams: list[int], low: int, high: int) -> int | None:
    """The greatest of the ordered seams within low..high."""
    i = bisect_right(seams, high) - 1
    return seams[i] if i >= 0 and seams[i] >= low else None


def window_spans(first: int, last: int, structural: list[int], sentence: list[int], atoms: list[tuple[int, int]] = (), chars: int = CHILD_CHARS, tokens: int = CHILD_TOKENS) -> list[tuple[int, int]]:
    """Overlapping windows over the places first..last of a stream, by its ordered seams.

    A window has at most ``chars`` characters and ``tokens`` tokens of four characters. Its end goes back to an
    element's start, else a sentence end, within SEAM_REACH. The next one starts OVERLAP_MIN..OVERLAP_MAX before
    that end, at the last sentence end there, else element's start, else OVERLAP before it; where that would
    not move on, at the end itself. A tail that is shorter than OVERLAP_MAX, or follows a window that is, joins
    it if the tokens allow. Atoms have windows of their own, several if they are too long for one."""
    out, start, most = [], first, 4 * tokens + 3
    begins = [a for a, _ in atoms]
    while start < last:
        at = bisect_right(begins, start)
        atom = atoms[at - 1] if at and start < atoms[at - 1][1] else None
        if atom:
            if atom[1] - atom[0] <= most:
                out.append(atom)
            else:
                out += [(at, min(last, at + min(chars, most))) for at in range(atom[0], atom[1], min(chars, most))]
            start = atom[1]
            continue
        end = min(last, start + min(chars, most))
        end = min(end, begins[at]) if at < len(begins) else end
        low = max(start + 1, end - SEAM_REACH)
        end = _last(structural, low, end) or _last(sentence, low, end) or end
        if (last - end < OVERLAP_MAX or end - start <= OVERLAP_MAX) and last - start <= most:
            end = last
        out.append((start, end))
        if end >= last:
            break
        low, high = max(first + 1, end - OVERLAP_MAX), end - OVERLAP_MIN
        after = _last(sentence, low, high) or _last(structural, low, high) or max(first, end - OVERLAP)
        start = after if after > start else end
    return out


def windows(text: str) -> list[tuple[int, int]]:
    """The windows of a text that is one element."""
    return window_spans(0, len(text), [], sentence_seams(text))


def sliding_windows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, chunk_index, char_start, char_end, text of the windows of every text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, a, z, t[a:z]) for k, t in zip(f[key], f["text"]) if t for i, (a, z) in enumerate(windows(t))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "char_start", "char_end", "text"])

    return docs.select(key, "text").mapInPandas(run, f"{key} {kind}, chunk_index long, char_start long, char_end long, text string")


def _streams(elements: DataFrame, doc: str, order: str, text: str, *more: Column) -> DataFrame:
    """doc and the elements with a text as ``es``, an array in order."""
    said = elements.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    return said.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"), *more))).alias("es"))


def _joined(texts: list[str]) -> tuple[str, list[int]]:
    """The texts with a blank line between, and where each starts."""
    starts, at = [], 0
    for t in texts:
        starts.append(at)
        at += len(t) + 2
    return "\n\n".join(texts), starts


def windows_of(texts: list[str]) -> list[tuple[int, int]]:
    """The windows over the stream of these elements."""
    stream, starts = _joined(texts)
    return window_spans(0, len(stream), starts[1:], sentence_seams(stream))


def element_windows(elements: DataFrame, doc: str, order: str, text: str = "text", atomic: Column | None = None) -> DataFrame:
    """doc, win, w_start, w_end, text, first, last (order): windows over each document's stream of elements, and
    the elements that a window overlaps. Elements for which ``atomic`` holds have windows of their own."""
    kinds = {f.name: f.dataType.simpleString() for f in elements.schema.fields}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, es in zip(f[doc], f["es"]):
                texts = [e["t"] for e in es]
                stream, starts = _joined(texts)
                atoms = [(a, a + len(t)) for a, t, e in zip(starts, texts, es) if e["alone"]]
                for i, (a, z) in enumerate(window_spans(0, len(stream), starts[1:], sentence_seams(stream), atoms)):
                    low = bisect_right(starts, a) - 1
                    low += starts[low] + len(texts[low]) <= a
                    rows.append((d, i, a, z, stream[a:z], es[min(low, len(es) - 1)]["o"], es[bisect_left(starts, z) - 1]["o"]))
            yield pd.DataFrame(rows, columns=[doc, "win", "w_start", "w_end", "text", "first", "last"])

    alone = (F.coalesce(atomic, F.lit(False)) if atomic is not None else F.lit(False)).alias("alone")
    return _streams(elements, doc, order, text, alone).mapInPandas(run, f"{doc} {kinds[doc]}, win long, w_start long, w_end long, text string, first {kinds[order]}, last {kinds[order]}")


def coalesce_run(texts: list[str], band: tuple[int, int] = CHILDREN, tokens: int = PARENT_TOKENS, atomic: list[bool] | None = None) -> list[tuple[int, int, int]]:
    """(first, after, windows) of the parents of a run of blocks, of which the atomic ones have windows of their own: as few parents as can be whose windows are
    within the band (the last may have fewer) and whose text within the tokens, and of those the ones nearest
    to the upper end of the band in sum. A block that fits nowhere is a parent alone."""
    stream, starts = _joined(texts)
    seams = sentence_seams(stream)
    ends = [a + len(t) for a, t in zip(starts, texts)]
    atoms = [(a, z) for a, z, own in zip(starts, ends, atomic or []) if own]
    begins = [a for a, _ in atoms]
    best: list[tuple | None] = [(0, 0, None, 0)] + [None] * len(texts)
    for i in range(len(texts)):
        if best[i] is None:
            continue
        for j in range(i + 1, len(texts) + 1):
            size = ends[j - 1] - starts[i]
            if j > i + 1 and max(1, size // 4) > tokens:
                break
            if j > i + 1 and j < len(texts) and size < (band[0] - 2) * (CHILD_CHARS - OVERLAP_MAX - SEAM_REACH):
                continue  # too short for the least number of windows
            own = atoms[bisect_left(begins, starts[i]) : bisect_left(begins, ends[j - 1])]
            n = len(window_spans(starts[i], ends[j - 1], starts[i + 1 : j], seams, own))
            if j > i + 1 and not (n <= band[1] and (n >= band[0] or j == len(texts))):
                continue
            lone = not band[0] <= n <= band[1] and j < len(texts)
            cost = (best[i][0] + 1 + lone * len(texts), best[i][1] + abs(band[1] - n), i, n)
            if best[j] is None or cost[:2] < best[j][:2]:
                best[j] = cost
    out, j = [], len(texts)
    while j:
        out.append((best[j][2], j, best[j][3]))
        j = best[j][2]
    return out[::-1]


def banded_parents(blocks: DataFrame, doc: str, order: str, text: str = "text", seam: Column | None = None, atomic: Column | None = None) -> DataFrame:
    """doc, parent (from 0), first, last (order), n_blocks, n_children, n_chars: parents over consecutive blocks.

    A block for which ``seam`` holds is a parent alone; one that is atomic (code) has windows of its own. The runs between are coalesced by dynamic programming
    (coalesce_run). A document is one row, documents run in parallel."""
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, es in zip(f[doc], f["es"]):
                n, at = 0, 0
                while at < len(es):
                    z = at + 1
                    while not es[at]["alone"] and z < len(es) and not es[z]["alone"]:
                        z += 1
                    texts = [e["t"] for e in es[at:z]]
                    for a, b, k in coalesce_run(texts, atomic=[e["code"] for e in es[at:z]]):
                        rows.append((d, n, es[at + a]["o"], es[at + b - 1]["o"], b - a, k, sum(map(len, texts[a:b])) + 2 * (b - a - 1)))
                        n += 1
                    at = z
            yield pd.DataFrame(rows, columns=[doc, "parent", "first", "last", "n_blocks", "n_children", "n_chars"])

    alone = (F.coalesce(seam, F.lit(False)) if seam is not None else F.lit(False)).alias("alone")
    code = (F.coalesce(atomic, F.lit(False)) if atomic is not None else F.lit(False)).alias("code")
    return _streams(blocks, doc, order, text, alone, code).mapInPandas(run, f"{doc} {kinds[doc]}, parent long, first {kinds[order]}, last {kinds[order]}, n_blocks long, n_children long, n_chars long")


def window_owners(elements: DataFrame, wins: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Pairs of windows (win, w_start, w_end) and elements (element, e_start, e_end) of a document that overlap.

    Spans are cut into cells of the window size, so that the join is an equi-join on (document, cell)
    and only near spans are compared; a pair is kept in the first cell that both touch."""
    cell = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / CHILD_CHARS), F.floor((F.greatest(F.col(b) - 1, F.col(a))) / CHILD_CHARS)))
    e = elements.select(doc, "element", "e_start", "e_end").withColumn("_cell", cell("e_start", "e_end"))
    w = wins.select(doc, "win", "w_start", "w_end").withColumn("_cell", cell("w_start", "w_end"))
    met = e.join(w, [doc, "_cell"]).where("e_start < w_end and e_end > w_start")
    first = F.greatest(F.floor(F.col("e_start") / CHILD_CHARS), F.floor(F.col("w_start") / CHILD_CHARS))
    return met.where(F.col("_cell") == first).drop("_cell")


def tabular_parents(rows: DataFrame, table: str, order: str, text: str, columns: list[str], band: int = 8, sample: int = 5) -> DataFrame:
    """Bands of ``band`` row numbers: table, band, n_rows, row_min, row_max, and a text of the schema and the first rows.

    The band follows from the row's own number, so no table passes one task."""
    banded = rows.withColumn("band", F.floor(F.col(order) / band).cast("long"))
    first = F.slice(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), 1, sample)
    out = banded.groupBy(table, "band").agg(F.count(F.lit(1)).alias("n_rows"), F.min(order).alias("row_min"), F.max(order).alias("row_max"), first.alias("_first"))
    body = F.array_join(F.transform("_first", lambda x: x["t"]), "\n")
    return out.withColumn("text", F.concat(F.lit("schema: " + " | ".join(columns) + "\n"), body)).drop("_first")


def fold_small(elements: DataFrame, doc: str, order: str, text: str = "text", least: int = 60) -> DataFrame:
    """doc, order, text, n_folded: texts of under ``least`` characters join the next longer one of their
    document, those behind the last one join that, with a blank line between.

    Blank texts go. A document without a longer text, or of a single element, stays as it is."""
    bare = F.trim(F.coalesce(F.col(text), F.lit("")))
    w = Window.partitionBy(doc)
    marked = elements.select(doc, order, text, (F.length(bare) >= least).cast("int").alias("_big"), (bare != "").alias("_said"))
    marked = marked.withColumn("_bigs", F.sum("_big").over(w)).withColumn("_rows", F.count(F.lit(1)).over(w))
    plain = (F.col("_bigs") == 0) | (F.col("_rows") < 2)
    before = F.coalesce(F.sum("_big").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = marked.withColumn("_group", F.least(before, F.col("_bigs") - 1)).where(F.col("_said") | plain)
    folded = grouped.where(~plain).groupBy(doc, "_group").agg(
        F.max(F.when(F.col("_big") == 1, F.col(order))).alias(order),
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_parts"),
    )
    joined = folded.select(doc, order, F.array_join(F.transform("_parts", lambda x: x["t"]), "\n\n").alias(text), F.size("_parts").cast("long").alias("n_folded"))
    return joined.unionByName(grouped.where(plain).select(doc, order, text, F.lit(1).cast("long").alias("n_folded")))


def cap_text(text: Column, most: int = 20_000, marker: str = TRUNCATED) -> Column:
    """The text, or as much of it as fits into ``most`` characters with the marker."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - len(marker)), F.lit(marker))).otherwise(text)


def section_paths(elements: DataFrame, doc: str, order: str, level: str, text: str, levels: int = 6) -> DataFrame:
    """Adds section_path: the headings above each element, a heading itself included.

    A heading closes all of its own level and deeper; an element whose level is null is no heading."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col(level) == n, F.struct(F.col(order).alias("at"), F.col(text).alias("title"))), ignorenulls=True).over(w) for n in range(1, levels + 1)]
    out = elements.select("*", *[c.alias(f"_l{n}") for n, c in enumerate(last, 1)])
    open_ = []
    for n in range(1, levels + 1):
        later = [~F.coalesce(F.col(f"_l{m}.at") > F.col(f"_l{n}.at"), F.lit(False)) for m in range(1, n)]
        valid = F.col(f"_l{n}").isNotNull()
        for c in later:
            valid = valid & c
        open_.append(F.when(valid, F.struct(F.col(f"_l{n}.title").alias("title"))))
    path = F.transform(F.filter(F.array(*open_), lambda x: x.isNotNull()), lambda x: x["title"])
    return out.withColumn("section_path", path).drop(*[f"_l{n}" for n in range(1, levels + 1)])


#: What a location may tell, and how a summary gathers it.
PLACES = {"page": "pages", "slide": "slides", "sheet": "sheets", "cell_range": "cell_ranges", "json_path": "json_paths", "dom_path": "dom_paths"}


def location_summary(locations: Column, most_paths: int = 50, fields: tuple[str, ...] = ("page", "sheet", "json_path", "row_start", "row_end")) -> Column:
    """A struct of what an array of locations covers, for those of its fields that are named: sorted pages and slides;
    sheets, cell_ranges, json_paths (at most ``most_paths``, as stored with a chunk) and dom_paths as first seen, without
    empty ones; row_min and row_max, line_min and line_max."""
    def seen(name: str) -> Column:
        kept = F.filter(F.transform(locations, lambda x: x[name]), lambda v: v.isNotNull() & (v.cast("string") != ""))
        return F.array_distinct(kept)

    out = []
    for name, many in PLACES.items():
        if name in fields:
            v = seen(name)
            out.append((F.array_sort(v) if name in ("page", "slide") else F.slice(v, 1, most_paths) if name == "json_path" else v).alias(many))
    for what in ("row", "line"):
        if f"{what}_start" in fields:
            out += [F.array_min(F.transform(locations, lambda x: x[f"{what}_start"])).alias(f"{what}_min"), F.array_max(F.transform(locations, lambda x: x[f"{what}_end"])).alias(f"{what}_max")]  # noqa: B023
    return F.struct(*out)


def cap_tokens(text: Column, most: int = PARENT_TOKENS, marker: str = TRUNCATED) -> Column:
    """The text, or as much of it as fits into ``most`` tokens less those of the marker (tokens of both are rounded down,
    so together they may be one more), cut behind the last space, newline or sentence within OVERLAP_MAX characters, or
    hard if there is none."""
    limit = 4 * (most - max(1, len(marker) // 4)) + 3
    # the character before the reach, the reach, and one to look ahead at
    tail = F.substring(text, limit - OVERLAP_MAX, OVERLAP_MAX + 2)
    seam = F.length(F.regexp_extract(tail, r"(?s)^.*(?:[ \t\n]|[.!?;](?=[ \n]))(?=.)", 0))
    cut = F.when(seam > 0, limit - OVERLAP_MAX - 1 + seam).otherwise(limit)
    return F.when(F.floor(F.length(text) / 4) > most, F.concat(F.substring(text, F.lit(1), cut), F.lit(marker))).otherwise(text)


def sheet_parents(rows: DataFrame, tables: DataFrame, keys: list[str], order: str, text: str = "text", band: int = 8, sample: int = 5) -> DataFrame:
    """keys, band (from 0), n_rows, row_min, row_max, text: parents of every table, ``band`` rows each by their place.

    tables: keys, columns (array), sheet (null for a table without). The text names the sheet and the columns and shows
    the first rows; a table without any of these is ``(empty sheet)`` or ``(empty table)``, and one without rows has
    one parent all the same. Rows are numbered by ranges, so a table may be larger than a task."""
    placed = numbered(rows.select(*keys, order, text), keys, [order], "_n").withColumn("band", F.floor(F.col("_n") / band).cast("long"))
    first = F.slice(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), 1, sample)
    per = placed.groupBy(*keys, "band").agg(F.count(F.lit(1)).alias("n_rows"), F.min(order).alias("row_min"), F.max(order).alias("row_max"), first.alias("_first"))
    met = tables.select(*keys, "columns", "sheet").join(per, keys, "left")
    names = F.when(F.size("columns") > 0, F.concat(F.lit("schema: "), F.array_join("columns", " | ")))
    head = F.concat_ws("\n", F.concat(F.lit("sheet: "), F.nullif("sheet", F.lit(""))), names)
    body = F.array_join(F.transform("_first", lambda x: x["t"]), "\n")
    said = F.concat_ws("\n\n", F.nullif(head, F.lit("")), F.when(F.size("_first") > 0, body))
    nothing = F.when(F.col("sheet").isNull(), "(empty table)").otherwise("(empty sheet)")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return met.select(*keys, zero("band"), zero("n_rows"), "row_min", "row_max", F.when(said == "", nothing).otherwise(said).alias("text"))
