"""Suggested fixes: file changes in response texts, applying and undoing them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from triage.functions.paths import is_unsafe
from triage.functions.text import bind, let, split_lines

# Fences, headers before a fence, and diff spellings.
FENCE = r"(?s)```([\w+-]*)\n(.*?)```"
HEADER_REACH = 200
HEADERS = (
    r"^#{1,6}\s*File:\s*(\S+)\s*$",
    r"^\*\*File:?\*\*:?\s*`?([^\s`]+)`?\s*$",
    r"^File:\s*`?([^\s`]+)`?\s*$",
)
DIFF_LANGS = ("diff", "patch")
LOOKS_LIKE_DIFF = r"(?md)^--- a/\S+"
DIFF_START = r"(?md)(?=^--- a/)"
DIFF_PATH = r"(?md)^\+\+\+ b/(\S+)"
HUNK_START = r"(?md)(?=^@@ -)"
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
# Files whose texts one task of ``apply`` sorts at most on average, and those that are not worth a task of their own.
FILES_PER_TASK, FEW_FILES = 20_000, 1_000
FULL_FILE, UNIFIED_DIFF = "full_file", "unified_diff"

_CHANGE = "struct<path:string,format:string,new_content:string,diff_text:string>"
_NO_CHANGES = f"cast(array() as array<{_CHANGE}>)"


def header_path(window: Column) -> Column:
    """Path of the last file header in a text window, NULL if there is none."""
    def last(pattern: str) -> Column:
        found = rf"(?smid)\A(.*){pattern}"
        path = F.regexp_extract(window, found, 2)
        before = F.length(F.regexp_extract(window, found, 1))
        return F.struct(F.when(path != "", before).otherwise(-1).alias("at"), path.alias("path"))

    best = F.array_max(F.array(*[last(p) for p in HEADERS]))
    return F.nullif(best["path"], F.lit(""))


def blocks(responses: DataFrame) -> DataFrame:
    """Add ``blocks``: every fence with its language, content and preceding header path.

    Only the last 200 characters before a fence are searched for a header. They
    are carried along the text piece by piece, so they may reach over an earlier
    fence exactly as they do in the text.
    """
    text = F.col("text")
    fence = F.lit(FENCE)
    pieces = F.arrays_zip(
        F.slice(F.split(text, FENCE, -1), F.lit(1), F.size(F.regexp_extract_all(text, fence, F.lit(0)))).alias("piece"),
        F.regexp_extract_all(text, fence, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, fence, F.lit(1)).alias("lang"),
        F.regexp_extract_all(text, fence, F.lit(2)).alias("content"),
    )
    walk = f"""
    aggregate(_pieces,
      named_struct('tail', '', 'out', cast(array() as array<struct<lang:string,content:string,lead:string>>)),
      (s, z) -> named_struct(
        'tail', right(concat(s.tail, z.piece, z.whole), {HEADER_REACH}),
        'out', concat(s.out, array(named_struct(
          'lang', lower(z.lang), 'content', z.content,
          'lead', right(concat(s.tail, z.piece), {HEADER_REACH}))))),
      s -> s.out)"""
    led = let(let(responses, _pieces=pieces), _led=F.expr(walk))
    return let(
        led,
        blocks=F.transform(
            "_led",
            lambda b: F.struct(
                b["lang"].alias("lang"),
                b["content"].alias("content"),
                header_path(b["lead"]).alias("header_path"),
            ),
        ),
    ).drop("_pieces", "_led")


def file_diffs(diff: Column) -> Column:
    """One change per file of a diff text; parts without a new path are dropped."""
    parts = F.filter(F.split(diff, DIFF_START, -1), lambda p: p.rlike(r"\S"))
    named = F.filter(parts, lambda p: p.rlike(DIFF_PATH))
    return F.transform(
        named,
        lambda p: F.struct(
            F.regexp_extract(p, DIFF_PATH, 1).alias("path"),
            F.lit(UNIFIED_DIFF).alias("format"),
            F.lit(None).cast("string").alias("new_content"),
            p.alias("diff_text"),
        ),
    )


def _changes_of(block: Column) -> Column:
    is_diff = block["lang"].isin(*DIFF_LANGS) | block["content"].rlike(LOOKS_LIKE_DIFF)
    full = F.array(
        F.struct(
            block["header_path"].alias("path"),
            F.lit(FULL_FILE).alias("format"),
            F.regexp_replace(block["content"], r"\n\z", "").alias("new_content"),
            F.lit(None).cast("string").alias("diff_text"),
        )
    )
    return (
        F.when(is_diff, file_diffs(block["content"]))
        .when(block["header_path"].isNotNull(), full)
        .otherwise(F.expr(_NO_CHANGES))
    )


def file_changes(responses: DataFrame) -> DataFrame:
    """``response_id, pos, path, format, new_content, diff_text, status``.

    ``responses(response_id, text)``. A response without any change keeps one row
    with ``status`` = ``unparseable``. No shuffle: a response is one row.
    """
    keys = [c for c in responses.columns if c != "text"]
    found = F.flatten(F.transform("blocks", _changes_of))
    return (
        blocks(responses)
        .select(*keys, F.posexplode_outer(found).alias("pos", "c"))
        .select(
            *keys, "pos", "c.*",
            F.when(F.col("c").isNull(), "unparseable").otherwise("parsed").alias("status"),
        )
    )


# --- applying ---------------------------------------------------------------------


def _hunks(diff: Column) -> Column:
    """Hunks of one file's diff: positions, old and new lines (line feeds kept)."""
    parts = F.filter(F.split(diff, HUNK_START, -1), lambda p: p.rlike(HUNK))

    def count(part: Column, group: int) -> Column:
        n = F.regexp_extract(part, HUNK, group)
        return F.when(n == "", 1).otherwise(n.cast("int"))

    def typed_lines(lines: Column) -> Column:
        # "\ No newline at end of file" takes the line feed of the line before it
        def typed(l: Column, i: Column) -> Column:
            next_ = F.coalesce(F.get(lines, i + 1), F.lit(""))
            end = F.when(F.startswith(next_, F.lit("\\")), "").otherwise("\n")
            return F.struct(
                F.when(l == "", " ").otherwise(F.left(l, F.lit(1))).alias("op"),
                F.concat(F.substr(l, F.lit(2)), end).alias("t"),
            )

        return F.filter(F.transform(lines, typed), lambda x: x["op"] != "\\")

    def hunk(part: Column) -> Column:
        body = F.split(F.regexp_replace(part, r"\n+\z", ""), r"\n", -1)
        lines = F.slice(body, F.lit(2), F.lit(2_000_000_000))
        return bind(bind(lines, typed_lines), lambda typed: made(part, typed))

    def made(part: Column, typed: Column) -> Column:
        old = F.transform(F.filter(typed, lambda x: x["op"].isin(" ", "-")), lambda x: x["t"])
        new = F.transform(F.filter(typed, lambda x: x["op"].isin(" ", "+")), lambda x: x["t"])
        return F.struct(
            F.regexp_extract(part, HUNK, 1).cast("int").alias("old_start"),
            F.regexp_extract(part, HUNK, 3).cast("int").alias("new_start"),
            old.alias("old"),
            new.alias("new"),
            (F.try_element_at(typed, F.lit(-1))["op"] == " ").alias("trails"),
            (
                (F.size(old) == count(part, 2))
                & (F.size(new) == count(part, 4))
                & ~F.exists(typed, lambda x: ~x["op"].isin(" ", "-", "+"))
            ).alias("sound"),
        )

    return F.transform(parts, hunk)


def _apply_hunks(lines: str, hunks: str) -> str:
    """Lines after all hunks, NULL if one does not fit.

    Old lines must be equal, line feeds included. The stated place is tried
    first, then the nearest one (forwards before backwards) behind the previous
    hunk. A hunk for line 1 must match at the start and a hunk without trailing
    context at the end of the file.
    """
    fits = f"slice({lines}, p, size(h.old)) = h.old and p >= s.at and p + size(h.old) - 1 <= size({lines})"
    anchored = f"""(h.old_start > 1 or p = 1) and (h.trails or p + size(h.old) - 1 = size({lines}))"""
    here = "h.new_start - s.shift"
    place = f"""
    transform(array(
      case when h.old_start <= 1 then 1
           when not h.trails then size({lines}) - size(h.old) + 1
           else {here} end), want ->
      coalesce(
        get(filter(array(want), p -> p >= 1 and {fits} and {anchored}), 0),
        if(h.trails and h.old_start > 1, array_min(transform(
          filter(if(size({lines}) = 0, cast(array() as array<int>), sequence(1, size({lines}))), p -> {fits}),
          p -> named_struct('far', abs(p - want), 'back', p < want, 'p', p))).p, null)))[0]"""
    return f"""
    aggregate({hunks},
      named_struct('at', 1, 'shift', 0, 'ok', size({hunks}) > 0,
                   'out', cast(array() as array<array<string>>)),
      (s, h) -> transform(array(if(s.ok and h.sound, {place}, null)), q -> if(q is null,
        named_struct('at', s.at, 'shift', s.shift, 'ok', false, 'out', s.out),
        named_struct('at', q + size(h.old), 'shift', s.shift + size(h.new) - size(h.old), 'ok', true,
          'out', concat(s.out, array(slice({lines}, s.at, q - s.at), h.new)))))[0],
      s -> if(s.ok, flatten(concat(s.out, array(slice({lines}, s.at, greatest(size({lines}) - s.at + 1, 0))))), null))"""


def apply(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Apply every response to the base files, all of its changes or none.

    ``changes(response_id, repo, pos, path, format, new_content, diff_text)`` and
    ``files(repo, path, content)`` give ``response_id, repo, path, existed_before,
    old_content, new_content, ok, applied, error``; ``new_content`` is NULL where the
    response is not applied. Several changes of one file are applied in order.
    Paths that are absolute or contain ``..`` are rejected.

    A file text meets its diffs in one row: the join on (repo, path) is the only
    shuffle of texts, there is no join line by line. It has a task for every ``FILES_PER_TASK`` files:
    texts are packed tightly in a shuffle, and partitions joined by packed size would sort too many at once.
    """
    rows = files.count()
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-rows // FILES_PER_TASK))
    tasks = max(1, min(tasks, -(-rows // FEW_FILES)))
    step = F.struct("pos", "format", "new_content", "diff_text")
    per_file = (
        changes.where("path is not null")
        .groupBy("response_id", "repo", "path")
        .agg(F.sort_array(F.collect_list(step)).alias("_steps"))
    )
    prepared = F.transform(
        "_steps",
        lambda c: F.struct(
            c["format"].alias("format"),
            c["new_content"].alias("text"),
            c["diff_text"].rlike(r"(?md)^--- /dev/null").alias("creates"),
            F.coalesce(_hunks(c["diff_text"]), F.expr(
                "cast(array() as array<struct<old_start:int,new_start:int,old:array<string>,"
                "new:array<string>,trails:boolean,sound:boolean>>)")).alias("hunks"),
        ),
    )
    base = files.select("repo", "path", F.col("content").alias("old_content"))
    per_file, base = per_file.repartition(tasks, "repo", "path"), base.repartition(tasks, "repo", "path")
    joined = let(per_file.join(base, ["repo", "path"], "left"), _prep=prepared).withColumn(
        "existed_before", F.col("old_content").isNotNull()
    )
    lines = "filter(split(coalesce(s.text, ''), r'(?<=\\n)', -1), l -> l <> '')"
    fold = f"""
    aggregate(_prep,
      named_struct('text', old_content, 'ok', true),
      (s, c) -> case
        when not s.ok then s
        when c.format = '{FULL_FILE}' then named_struct('text', coalesce(c.text, ''), 'ok', true)
        when (s.text is null) <> c.creates then named_struct('text', s.text, 'ok', false)
        else transform(array({lines}), ls -> transform(array({_apply_hunks("ls", "c.hunks")}), done ->
          named_struct('text', if(done is null, s.text, array_join(done, '')), 'ok', done is not null))[0])[0]
      end)"""
    whole = W.partitionBy("response_id")
    return (
        let(joined, _r=F.expr(fold))
        .withColumn("_unsafe", is_unsafe(F.col("path")))
        .withColumn("ok", F.col("_r.ok") & ~F.col("_unsafe"))
        .withColumn("applied", F.bool_and("ok").over(whole))
        .select(
            "response_id", "repo", "path", "existed_before", "old_content",
            F.when(F.col("applied"), F.col("_r.text")).alias("new_content"),
            "ok", "applied",
            F.when(F.col("_unsafe"), "unsafe path")
            .when(~F.col("ok"), "patch does not apply")
            .when(~F.col("applied"), "another file of the patch failed")
            .alias("error"),
        )
    )


def apply_diffs(changes: DataFrame, files: DataFrame) -> DataFrame:
    """``apply`` for the unified diffs among the changes."""
    return apply(changes.where(F.col("format") == UNIFIED_DIFF), files)


def apply_status(changes: DataFrame, applied: DataFrame) -> DataFrame:
    """``response_id, status``: ``applied``, ``not_applied`` or ``unparseable``."""
    states = applied.groupBy("response_id").agg(F.bool_and("applied").alias("_ok"))
    status = F.when(F.col("_ok"), "applied").when(~F.col("_ok"), "not_applied").otherwise("unparseable")
    return changes.select("response_id").distinct().join(states, "response_id", "left").select(
        "response_id", status.alias("status")
    )


def apply_full_files(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Next snapshot of ``files(repo, path, version, content)`` after whole-file changes.

    ``changes(repo, path, new_content)``, one per path. Changed files get the next
    version, new files version 1, all others stay as they are.
    """
    new = changes.select("repo", "path", "new_content")
    changed = F.col("new_content").isNotNull()
    return files.join(new, ["repo", "path"], "full_outer").select(
        "repo",
        "path",
        F.when(changed, F.coalesce(F.col("version"), F.lit(0)) + 1).otherwise(F.col("version")).alias("version"),
        F.coalesce("new_content", "content").alias("content"),
    )


def rollback(versions: DataFrame, bad_version: int) -> DataFrame:
    """Snapshot before ``bad_version``: the newest older version of every path.

    Files that the bad version created have none and drop out. A limit of one
    row per path, so only the survivors are shuffled.
    """
    newest = W.partitionBy("repo", "path").orderBy(F.col("version").desc())
    return (
        versions.where(F.col("version") < bad_version)
        .withColumn("_rn", F.row_number().over(newest))
        .where("_rn = 1")
        .drop("_rn")
    )


# --- comparing snapshots ----------------------------------------------------------


def file_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``repo, path, change``: added, removed or modified files, judged by content hash."""
    a = old.select("repo", "path", F.sha2("content", 256).alias("_a"))
    b = new.select("repo", "path", F.sha2("content", 256).alias("_b"))
    change = (
        F.when(F.col("_a").isNull(), "added")
        .when(F.col("_b").isNull(), "removed")
        .when(F.col("_a") != F.col("_b"), "modified")
    )
    return (
        a.join(b, ["repo", "path"], "full_outer")
        .select("repo", "path", change.alias("change"))
        .where("change is not null")
    )


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``repo, path, change, added_lines, removed_lines`` of every changed file.

    Lines are compared as bags. Both texts of a file meet in one row and equal
    files are dropped before any line is looked at. The changed lines are then
    counted per (file, line), combined on the map side.
    """
    a = old.select("repo", "path", F.col("content").alias("_a"))
    b = new.select("repo", "path", F.col("content").alias("_b"))
    pairs = a.join(b, ["repo", "path"], "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    none = F.expr("cast(array() as array<string>)")

    def signed(text: str, sign: int) -> Column:
        lines = F.coalesce(split_lines(text), none)
        return F.transform(lines, lambda l: F.struct(l.alias("line"), F.lit(sign).alias("n")))

    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("modified")
    both = F.concat(signed("_a", -1), signed("_b", 1))
    net = (
        pairs.select("repo", "path", change.alias("change"), F.explode_outer(both).alias("l"))
        .groupBy("repo", "path", "change", "l.line")
        .agg(F.sum("l.n").alias("n"))
    )
    return net.groupBy("repo", "path", "change").agg(
        F.coalesce(F.sum(F.greatest(F.col("n"), F.lit(0))), F.lit(0)).alias("added_lines"),
        F.coalesce(F.sum(F.greatest(-F.col("n"), F.lit(0))), F.lit(0)).alias("removed_lines"),
    )


HUNKS = "array<struct<old_start: int, old_lines: int, new_start: int, new_lines: int, moved: int>>"


def snapshot_hunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changed stretches of files that both snapshots hold: ``repo, path, hunk, old_start, old_lines,
    new_start, new_lines, moved``, line numbers from 1.

    Lines are aligned by patience: what both files begin and end with; between that, lines that
    occur once on either side, of which the longest run that rises on both sides is kept (of
    several, the one that ends first in the old file, and so on backwards); then what each gap
    begins and ends with. A hunk is a gap. ``moved`` counts its old lines that the new file holds
    once, but out of order. Files are compared in their row; equal ones are left out before.
    """
    a = old.select("repo", "path", F.col("content").alias("_old"))
    b = new.select("repo", "path", F.col("content").alias("_new"))
    pairs = a.join(b, ["repo", "path"]).where("_old <> _new")
    found = pairs.select("repo", "path", "_old", "_new").mapInArrow(_aligned(), f"repo string, path string, hunks {HUNKS}")
    return found.select("repo", "path", F.posexplode("hunks").alias("hunk", "h")).select(
        "repo", "path", (F.col("hunk") + 1).alias("hunk"), "h.*"
    )


def _aligned() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Built here so that tasks need no import of this package."""
    names = ("old_start", "old_lines", "new_start", "new_lines", "moved")
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in names]))

    def same_ends(a: list[str], b: list[str]) -> tuple[int, int]:
        """How many lines both begin with, and how many of the rest both end with."""
        least = min(len(a), len(b))
        begin = next((i for i in range(least) if a[i] != b[i]), least)
        rest = least - begin
        return begin, next((i for i in range(rest) if a[-1 - i] != b[-1 - i]), rest)

    def rising(at: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The longest run of pairs that rises on both sides; at each length the first possible end."""
        import bisect

        ends: list[int] = []  # smallest end on the new side for each length
        length = []
        for _, j in at:
            n = bisect.bisect_left(ends, j)
            ends[n : n + 1] = [j]
            length.append(n + 1)
        by_length: dict[int, list[tuple[int, int]]] = {}
        for pair, n in zip(at, length, strict=True):
            by_length.setdefault(n, []).append(pair)
        run: list[tuple[int, int]] = []
        for n in range(len(ends), 0, -1):
            run.append(next(p for p in by_length[n] if not run or p[0] < run[-1][0] and p[1] < run[-1][1]))
        return run[::-1]

    def hunks(a: list[str], b: list[str]) -> list[dict[str, int]]:
        begin, end = same_ends(a, b)
        count_a, count_b = Counter(a[begin : len(a) - end]), Counter(b[begin : len(b) - end])
        place = {t: j for j, t in enumerate(b) if begin <= j < len(b) - end and count_b[t] == 1}
        once = [(i, place[t]) for i, t in enumerate(a) if begin <= i < len(a) - end and count_a[t] == 1 and t in place]
        run = rising(once)
        moved = {i for i, _ in once} - {i for i, _ in run}
        out, i, j = [], begin, begin
        for x, y in [*run, (len(a) - end, len(b) - end)]:
            head, tail = same_ends(a[i:x], b[j:y])
            lo, hi = i + head, x - tail
            if hi > lo or y - tail > j + head:
                values = (lo + 1, hi - lo, j + head + 1, y - tail - j - head, sum(lo <= m < hi for m in moved))
                out.append(dict(zip(names, values, strict=True)))
            i, j = x + 1, y + 1
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column("_old").to_pylist(), batch.column("_new").to_pylist(), strict=True)
            found = [hunks(x.split("\n"), y.split("\n")) for x, y in texts]
            yield pa.RecordBatch.from_arrays([batch.column("repo"), batch.column("path"), pa.array(found, kind)], names=["repo", "path", "hunks"])

    return compare
