"""End-to-end jobs: the three things the tool set does, for many files at once.

E1 ``dedup_files``     HTML files -> deduplicated links (and HTML files)
E2 ``compare_files``   HTML files -> unique/intersection report
   ``diff_files``      two HTML files -> A/B difference report
E3 ``convert_json``    JSON files -> HTML files, named by count or by input

Options are function parameters (the scripts' flags); there is no CLI.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, dedup, naming
from ..operators.edit import without_links
from ..operators.extract import Tree, parse_bookmarks, resolve_tree
from ..operators.jsonsplits import flatten_json_splits
from ..operators.jsontree import CHROMIUM, JsonFields, flatten_json, items_from_json, json_errors, json_links
from ..operators.render import items_from_tree, render_documents, render_lines
from ..operators.splits import parse_splits
from ..operators.tolerant import tokenize_files, tokenize_tolerant
from ..options import CompareOptions, KeyOptions
from ..session import ensure_checkpoint_dir
from ..sources.documents import Listing, existing, html_targets, json_targets, listed, read_html_files, read_json_files
from ..sources.sinks import write_named_lines, write_named_pieces, write_table


def parse_files(
    spark: SparkSession, targets, recursive: bool = False, parser: str = "regex", reader: str = "whole"
) -> tuple[DataFrame, Tree]:
    """Read HTML bookmark files and parse them: ``(files, tree)``.

    ``parser`` is ``regex`` (fast, default) or ``html.parser`` (tolerant).  With
    ``reader`` ``whole`` a file is a row.  ``splits`` takes files of any size: the regex
    parser spreads a file over many tasks, the tolerant one reads it piece by
    piece.  All four give the same links; only ``pos`` counts tokens or bytes.
    (``lines`` is the former name of ``splits``.)
    """
    files, _, tree = _parsed(spark, html_targets(spark, targets, recursive), parser, reader)
    return files, tree


def _parsed(spark, found: Listing, parser: str, reader: str) -> tuple[DataFrame, DataFrame | None, Tree]:
    """The files, their documents (None if they are not read as rows), and the tree."""
    if parser not in ("regex", "html.parser"):
        raise ValueError("parser must be regex or html.parser")
    if reader not in ("whole", "splits", "lines"):
        raise ValueError("reader must be whole or splits")
    files = listed(found)
    if reader != "whole":
        if found.on_driver is not None:
            raise ValueError("reader=splits needs a store that tasks can open")
        return files, None, parse_splits(found.files) if parser == "regex" else resolve_tree(tokenize_files(files))
    docs = read_html_files(spark, found)
    return files, docs, parse_bookmarks(docs) if parser == "regex" else resolve_tree(tokenize_tolerant(docs))


def dedup_files(
    spark: SparkSession,
    targets: str | Iterable[str],
    opts: KeyOptions = KeyOptions(),
    batch_mode: str | None = None,
    output: str | None = None,
    html_output_dir: str | None = None,
    recursive: bool = False,
    parser: str = "regex",
    reader: str = "whole",
) -> DataFrame:
    """Remove duplicates inside each file.

    ``batch_mode`` None runs one mode (``opts.mode``); ``url``, ``url-title``
    or ``all`` run the batch form.  ``output`` writes the kept links as
    parquet partitioned by file; ``html_output_dir`` writes one deduplicated
    bookmark file per input and mode (``<name>.dedup-<mode>.html``, numbered
    where names meet): the input's own text without the removed bookmarks and
    their notes (``edit``).  An input without duplicates is copied as it is.
    """
    files, docs, tree = _parsed(spark, html_targets(spark, targets, recursive), parser, reader)
    modes = (opts.mode,) if batch_mode is None else dedup.BATCH_MODES.get(batch_mode, ())
    if batch_mode is None:
        kept = dedup.dedup(tree.links, opts).withColumn("mode", F.lit(opts.mode))
    else:
        kept = dedup.batch_dedup(tree.links, opts, batch_mode=batch_mode)
    if output or html_output_dir:
        # the outputs and the caller read one result
        ensure_checkpoint_dir(spark)
        kept = kept.checkpoint(eager=True)
    if output:
        write_table(kept, output, partition_by="mode")
    if html_output_dir:
        folder = html_output_dir.rstrip("/")
        for mode in modes:
            base = F.regexp_extract("file_id", r"([^/]*?)(\.[^./]*)?$", 1)
            target = F.concat(F.lit(folder + "/"), base, F.lit(f".dedup-{mode}.html"))
            there = existing(spark, spark.createDataFrame([(folder,)], "folder string"))
            named = naming.free_names(files.withColumn("target_path", target), "file_id", there)
            own = kept.where(F.col("mode") == mode)
            if docs is None:
                # documents of any size: written line by line
                lines = render_lines(items_from_tree(own, tree.folders), escape=False, docs=files.select(F.col("file_id").alias("doc")))
                write_named_lines(lines.join(named.withColumnRenamed("file_id", "doc"), "doc"))
                continue
            removed = tree.links.select("file_id", "pos").join(own, ["file_id", "pos"], "left_anti")
            # a file without any text has a piece too, so that it is written
            whole = without_links(docs, removed).unionByName(files.select("file_id", F.lit(-1).cast("bigint").alias("piece"), F.lit("").alias("text")))
            write_named_pieces(whole.join(named, "file_id"), ["piece"])
    return kept


def compare_files(
    spark: SparkSession,
    targets: Iterable[str],
    opts: CompareOptions = CompareOptions(),
    output: str | None = None,
    parser: str = "regex",
    reader: str = "whole",
) -> DataFrame:
    """E2 (many files): unique or intersection report, bookmarks and folders."""
    files, tree = parse_files(spark, list(targets), parser=parser, reader=reader)
    report = compare.multi_compare(tree.links, tree.folders, files, opts)
    if output:
        write_table(report, output, partition_by="item_kind")
    return report


def diff_files(
    spark: SparkSession, file_a: str, file_b: str, opts: CompareOptions = CompareOptions(), parser: str = "regex"
) -> DataFrame:
    """E2 (two files): what A has that B lacks and the reverse."""
    _, tree = parse_files(spark, [file_a, file_b], parser=parser)
    a, b = ([r.path for r in html_targets(spark, f).files.limit(2).collect()] for f in (file_a, file_b))
    if len(a) != 1 or len(b) != 1 or a == b:
        raise ValueError("diff needs two different files")
    return compare.diff_report(tree.links, tree.folders, a[0], b[0], opts)


def convert_json(
    spark: SparkSession,
    patterns: str | Iterable[str],
    output_dir: str | None = None,
    naming_rule: str = "smart",
    fields: JsonFields = CHROMIUM,
    write: bool = True,
    errors: str = "raise",
    reader: str = "whole",
) -> DataFrame:
    """JSON bookmark files -> HTML files.

    ``naming_rule`` ``smart`` names files ``bookmarks_<count>.html`` and
    numbers conflicts, also with files that are there already; ``stem`` names
    them after the input (the file of that name is replaced; equal stems of one
    run are numbered).  A file that can't be read as JSON is an error before
    anything is written; ``errors="skip"`` leaves such files out (they are the
    listed ones without a row).  Returns ``(path, n_links, target_path, text)``;
    ``text`` is put together only where it is asked for.  ``reader="splits"`` spreads
    each file over many tasks and takes files of any size.
    """
    patterns = [patterns] if isinstance(patterns, str) else list(patterns)
    found = json_targets(spark, patterns)
    ensure_checkpoint_dir(spark)
    # the trees are walked once; counts and documents read the same nodes
    if reader == "splits":
        nodes = flatten_json_splits(found.files, fields).checkpoint(eager=True)
    elif reader == "whole":
        nodes = flatten_json(read_json_files(spark, found), doc="path", js="js", fields=fields).checkpoint(eager=True)
    else:
        raise ValueError("reader must be whole or splits")
    unreadable = json_errors(nodes)
    if errors == "raise" and (bad := unreadable.take(1)):
        raise ValueError(f"not a readable JSON bookmark file: {bad[0].doc}: {bad[0].message}")
    files = listed(found, "path").join(unreadable, F.col("path") == F.col("doc"), "left_anti")
    counts = dedup.link_counts(files, json_links(nodes).withColumnRenamed("doc", "path"), "path")
    folders = naming.with_target_dir(counts, output_dir=output_dir.rstrip("/") if output_dir else None).select(F.col("target_dir").alias("folder"))
    taken = existing(spark, folders) if write else None
    if naming_rule == "smart":
        named = naming.smart_names(counts, output_dir=output_dir, taken=taken)
    elif naming_rule == "stem":
        named = naming.free_names(naming.stem_names(counts, output_dir=output_dir), "path")
    else:
        raise ValueError("naming_rule must be smart or stem")
    items = items_from_json(nodes)
    if write:
        # line by line: no document is a value, one may be written by many tasks
        lines = render_lines(items, escape=True, docs=files.select(F.col("path").alias("doc")))
        write_named_lines(lines.join(named.select(F.col("path").alias("doc"), "target_path"), "doc"))
    html = render_documents(items, fmt="html", escape=True)
    out = named.join(html.withColumnRenamed("doc", "path"), "path", "left").select(
        "path", "n_links", "target_path", F.coalesce("text", F.lit(_EMPTY_HTML)).alias("text")
    )
    return out


def _empty_html() -> str:
    from ..operators.render import NETSCAPE_FOOTER, NETSCAPE_HEADER

    return NETSCAPE_HEADER + "\n" + NETSCAPE_FOOTER + "\n"


_EMPTY_HTML = _empty_html()
