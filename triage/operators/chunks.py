"""Code chunks: one compact text per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.functions.text import let, line_range, split_lines


def build_chunks(files: DataFrame, symbols: DataFrame, max_body_chars: int | None = None) -> DataFrame:
    """``repo, path, chunk_id, symbol_name, qualified_name, kind, start_line, end_line, embedding_text``.

    The id is path, name and first line, so overloads differ. A body enters whole unless
    ``max_body_chars`` is given. Files without symbols give no chunk. The symbols of a file travel as one
    list, so the join moves every file text at most once and copies it never.
    """
    item = F.struct("pos", "name", "qualified_name", "kind", "start_line", "end_line", "docstring")
    per_file = symbols.groupBy("repo", "path").agg(F.sort_array(F.collect_list(item)).alias("_symbols"))
    joined = files.select("repo", "path", "content").join(per_file, ["repo", "path"])

    def chunk(lines, path, s):
        body = line_range(lines, s["start_line"], s["end_line"])
        if max_body_chars is not None:
            body = F.left(body, F.lit(max_body_chars))
        has_doc = F.coalesce(s["docstring"], F.lit("")) != ""
        text = F.concat_ws(
            "\n",
            F.concat(F.lit("File: "), path),
            F.concat(F.lit("Symbol: "), s["qualified_name"], F.lit(" ("), s["kind"], F.lit(")")),
            F.when(has_doc, F.concat(F.lit("Docstring: "), s["docstring"])),
            F.concat(F.lit("Code:\n"), body),
        )
        return F.struct(
            F.concat(path, F.lit("::"), s["qualified_name"], F.lit("@"), s["start_line"]).alias("chunk_id"),
            s["name"].alias("symbol_name"),
            s["qualified_name"].alias("qualified_name"),
            s["kind"].alias("kind"),
            s["start_line"].alias("start_line"),
            s["end_line"].alias("end_line"),
            text.alias("embedding_text"),
        )

    lined = let(joined, _lines=split_lines("content"))
    made = F.transform("_symbols", lambda s: chunk(F.col("_lines"), F.col("path"), s))
    return lined.select("repo", "path", F.explode(made).alias("c")).select("repo", "path", "c.*")
