"""

Every query reads the driver's tables (``pages``) or data Spark derives from
them (the ``links`` fixture of FIXTURES.md section 2, documents rendered from
it).  ``oracle_sql`` states the same result in DuckDB SQL; column names match.
"""

from __future__ import annotations

import os
import re
import sys
import uuid
from collections.abc import Callable

# The package sits next to this file; make it importable wherever the driver runs.
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markhive import CompareOptions, KeyOptions
from markhive.functions import decode_entities, decode_percent, url_scheme
from markhive.functions.urls import has_allowed_protocol
from markhive.operators import compare, dedup
from markhive.operators import naming
from markhive.operators.edit import joined, without_links
from markhive.operators.extract import extract_links, links_of, parse_bookmarks, resolve_tree, tokenize
from markhive.operators.tolerant import tokenize_tolerant
from markhive.operators.jsonsplits import flatten_json_splits
from markhive.operators.jsontree import flatten_json, items_from_json, json_folders, json_links
from markhive.operators.render import render_documents
from markhive.packaging import ship
from markhive.plans import jobs
from markhive.session import ensure_checkpoint_dir
from markhive.sources.documents import json_targets, pages_documents, read_html_files, read_json_files
from markhive.sources.fixtures import FLAT_END, FLAT_HEAD, fixture_documents, flat_pieces, links_fixture
from markhive.sources.sinks import write_named_documents, write_named_pieces

# The training-data operators are optional: the rest works without their subpackage.
try:
    import corpus_pipeline
    from markhive.llm.queries import ORACLE_SQL as _LLM_SQL
    from markhive.llm.queries import QUERIES as _LLM_QUERIES

    _LLM_QUERIES = {**_LLM_QUERIES, "pipeline": corpus_pipeline.run}
except ModuleNotFoundError as missing:
    # any other module that is missing is an error
    if not re.fullmatch(r"corpus_pipeline|markhive\.llm(\..*)?", missing.name or ""):
        raise
    _LLM_QUERIES, _LLM_SQL = {}, {}

SF_SMOKE = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- inputs


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_fixture(_pages(spark, sf_dir))


LINK_COLS = ["link_id", "file_id", "folder", "url", "title"]


# ---------------------------------------------------------------- flagship


def entry(spark: SparkSession) -> DataFrame:
    """Default dedup (v3 rules, url mode) of every file of the fixture at sf0.001."""
    return q_dedup_url(spark, SF_SMOKE)


# ---------------------------------------------------------------- queries


def q_fixture_links(spark, sf_dir):
    return _links(spark, sf_dir).select(*LINK_COLS)


def q_extract_links(spark, sf_dir):
    return extract_links(pages_documents(_pages(spark, sf_dir)))


# Hrefs that hold a '>': a bookmarklet in front of every link of the pages.
QUOTED = "javascript:if(a>b){x()}//"


def _quoted_documents(spark, sf_dir):
    html = F.replace("html", F.lit('href="'), F.lit(f'href="{QUOTED}'))
    return pages_documents(_pages(spark, sf_dir).withColumn("html", html))


def q_extract_quoted(spark, sf_dir):
    return extract_links(_quoted_documents(spark, sf_dir))


def q_extract_quoted_tolerant(spark, sf_dir):
    return links_of(tokenize_tolerant(_quoted_documents(spark, sf_dir)))


# What irregular files hold around a link: a comment and a script with links of their own, odd quotes, a link
# in another attribute, and, instead of an end tag, a comment in the title and the next structural tag.
GHOSTS = """<!-- "<a href="http://ghost">no</a> --><script>a < '<a href="http://ghost">no</a>';</script>"""
ODD_START = """<a title="it"s" x=don't rel='a href="ghost"' data-href="ghost" href=\""""
ODD_END = """<!-- > it's "odd --><DT>"""


def _irregular_documents(spark, sf_dir):
    html = F.replace("html", F.lit('<a href="'), F.lit(GHOSTS + ODD_START))
    html = F.when(F.col("page_id") % 2 == 0, F.replace(html, F.lit("</a>"), F.lit(ODD_END))).otherwise(html)
    unended = F.when(F.col("page_id") % 5 == 0, F.lit('<!-- <a href="ghost">no</a>')).otherwise(F.lit("<style><a href='ghost'>no</a>"))
    return pages_documents(_pages(spark, sf_dir).withColumn("html", F.concat(html, unended)))


def q_extract_irregular(spark, sf_dir):
    return extract_links(_irregular_documents(spark, sf_dir))


def q_extract_irregular_tolerant(spark, sf_dir):
    return links_of(tokenize_tolerant(_irregular_documents(spark, sf_dir)))


def q_pages_dedup(spark, sf_dir):
    """Crawled pages as link files (S4): the links each page keeps after dedup."""
    kept = dedup.dedup(extract_links(pages_documents(_pages(spark, sf_dir))), KeyOptions())
    return kept.select("file_id", "pos", "url", "title", "key_url")


def q_pages_presence(spark, sf_dir):
    """In how many pages each link occurs (A9 over crawled pages)."""
    links = extract_links(pages_documents(_pages(spark, sf_dir)))
    return compare.presence(links, CompareOptions(mode="url-title"))


def q_entity_decode(spark, sf_dir):
    return _links(spark, sf_dir).select(
        "link_id", decode_entities("url").alias("url_text"), decode_entities("title").alias("title_text")
    )


# Numeric references with more digits than any character needs.
LONG_REFERENCES = "&#000000038;&#x000000026;x&#99999999999;&#x0000000000e9;"


def q_entity_decode_long(spark, sf_dir):
    return _links(spark, sf_dir).select("link_id", decode_entities(F.concat("url", F.lit(LONG_REFERENCES))).alias("url_text"))


def q_entity_decode_pages(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", decode_entities("html").alias("text"))


def q_percent_decode(spark, sf_dir):
    return _links(spark, sf_dir).select("link_id", decode_percent("url").alias("url_decoded"))


def q_filter_protocol(spark, sf_dir):
    links = _links(spark, sf_dir)
    return links.where(has_allowed_protocol("url")).select("link_id", "file_id", url_scheme("url").alias("scheme"))


def _dedup_query(opts: KeyOptions):
    def q(spark, sf_dir):
        kept = dedup.dedup(_links(spark, sf_dir), opts, pos="link_id")
        return kept.select(*LINK_COLS, "key_url", "key_title")

    return q


DEDUP_VARIANTS = {
    "dedup_url": KeyOptions(),
    "dedup_url_title": KeyOptions(mode="url-title"),
    "dedup_strict": KeyOptions(strict_protocol=True),
    "dedup_slash": KeyOptions(ignore_slash=True),
    "dedup_v3_d": KeyOptions(decode=True),
    "dedup_v3_d_title": KeyOptions(mode="url-title", decode=True),
    "dedup_v2": KeyOptions(mode="url-title", profile="v2"),
    "dedup_v2_d": KeyOptions(mode="url-title", profile="v2", decode=True),
    "dedup_v1": KeyOptions(mode="url-title", profile="v1"),
    "dedup_v1_d": KeyOptions(mode="url-title", profile="v1", decode=True),
    "dedup_all_opts": KeyOptions(mode="url-title", decode=True, strict_protocol=True, ignore_slash=True),
}


def q_dedup_url(spark, sf_dir):
    return _dedup_query(DEDUP_VARIANTS["dedup_url"])(spark, sf_dir)


def q_dedup_removed(spark, sf_dir):
    gone = dedup.removed(_links(spark, sf_dir), KeyOptions(), pos="link_id")
    return gone.select(*LINK_COLS, "key_url", "kept_pos")


def _batch_query(batch_mode: str, opts: KeyOptions):
    def q(spark, sf_dir):
        kept = dedup.batch_dedup(_links(spark, sf_dir), opts, batch_mode=batch_mode, pos="link_id")
        return kept.select(*LINK_COLS, "mode", "key_url", "key_title")

    return q


BATCH_VARIANTS = {
    "batch_url": ("url", KeyOptions()),
    "batch_url_title": ("url-title", KeyOptions()),
    "batch_all": ("all", KeyOptions()),
    "batch_all_opts": ("all", KeyOptions(decode=True, strict_protocol=True, ignore_slash=True)),
    "batch_v1": ("all", KeyOptions(profile="v1")),
}


def q_presence(spark, sf_dir):
    return compare.presence(_links(spark, sf_dir))


def _compare_inputs(spark, sf_dir):
    # folders=None: folders come from the links' paths in the same pass
    links = _links(spark, sf_dir)
    files = links.select("file_id").distinct()
    return links, None, files


def _multi_query(opts: CompareOptions, kinds):
    def q(spark, sf_dir):
        links, folders, files = _compare_inputs(spark, sf_dir)
        return compare.multi_compare(links, folders, files, opts, pos="link_id", kinds=kinds)

    return q


MULTI_VARIANTS = {
    "multi_unique": (CompareOptions(), ("bookmark",)),
    "multi_intersection": (CompareOptions(analysis="intersection"), ("bookmark",)),
    "multi_folders_unique": (CompareOptions(), ("folder",)),
    "multi_folders_intersection": (CompareOptions(analysis="intersection"), ("folder",)),
    "multi_report": (CompareOptions(), ("bookmark", "folder")),
    "multi_report_intersection": (CompareOptions(analysis="intersection"), ("bookmark", "folder")),
    "multi_unique_d_f": (CompareOptions(decode=True, filter=True), ("bookmark",)),
    "multi_intersection_title": (CompareOptions(analysis="intersection", mode="url-title"), ("bookmark",)),
    "multi_unique_title_d": (CompareOptions(mode="url-title", decode=True), ("bookmark",)),
    "multi_folders_by_name": (CompareOptions(folder_key="name"), ("folder",)),
    "multi_folders_by_name_intersection": (CompareOptions(analysis="intersection", folder_key="name"), ("folder",)),
}

def _own_folder_query(opts: CompareOptions):
    """Folders of which some are in one file only, by path and by name."""

    def q(spark, sf_dir):
        own = F.when(F.col("link_id") % 7 == 0, F.concat("folder", F.lit("/own "), "file_id")).otherwise(F.col("folder"))
        links = _links(spark, sf_dir).withColumn("folder", own)
        return compare.multi_compare(links, None, links.select("file_id").distinct(), opts, pos="link_id", kinds=("folder",))

    return q


OWN_FOLDER_VARIANTS = {
    "multi_folders_own": CompareOptions(),
    "multi_folders_own_by_name": CompareOptions(folder_key="name"),
}

# The two files of the A/B reports.
FILE_A, FILE_B = "f0", "f1"


def _diff_query(opts: CompareOptions, kinds):
    def q(spark, sf_dir):
        links, folders, _ = _compare_inputs(spark, sf_dir)
        return compare.diff_report(links, folders, FILE_A, FILE_B, opts, pos="link_id", kinds=kinds)

    return q


DIFF_VARIANTS = {
    "diff_folders": (CompareOptions(), ("folder",)),
    "diff_report": (CompareOptions(), ("bookmark", "folder")),
    "diff_d": (CompareOptions(decode=True), ("bookmark", "folder")),
    "diff_f_title": (CompareOptions(filter=True, mode="url-title"), ("bookmark",)),
}


def q_diff_a_only(spark, sf_dir):
    return compare.only_in(_links(spark, sf_dir), FILE_A, FILE_B, pos="link_id", section="a_only")


def q_diff_b_only(spark, sf_dir):
    return compare.only_in(_links(spark, sf_dir), FILE_B, FILE_A, pos="link_id", section="b_only")


def _html_tree(spark, sf_dir):
    docs = fixture_documents(_pages(spark, sf_dir), "html").select("file_id", F.col("text").alias("html"))
    return parse_bookmarks(docs)


def q_extract_tolerant(spark, sf_dir):
    return links_of(tokenize_tolerant(pages_documents(_pages(spark, sf_dir))))


def q_html_roundtrip_tolerant(spark, sf_dir):
    docs = fixture_documents(_pages(spark, sf_dir), "html").select("file_id", F.col("text").alias("html"))
    links = resolve_tree(tokenize_tolerant(docs)).links
    return links.select("file_id", F.array_join("folder", "/").alias("folder"), "url", "title")


def q_html_roundtrip(spark, sf_dir):
    links = _html_tree(spark, sf_dir).links
    return links.select("file_id", F.array_join("folder", "/").alias("folder"), "url", "title")


def q_folder_list(spark, sf_dir):
    folders = _html_tree(spark, sf_dir).folders
    return folders.select("file_id", F.array_join("folder", "/").alias("folder"))


def _json_nodes(spark, sf_dir):
    docs = fixture_documents(_pages(spark, sf_dir), "json")
    return flatten_json(docs, doc="path", js="text")


def q_json_roundtrip(spark, sf_dir):
    links = json_links(_json_nodes(spark, sf_dir))
    return links.select(F.col("doc").alias("path"), F.array_join("folder", "/").alias("folder"), "url", "title")


def q_json_folder_list(spark, sf_dir):
    folders = json_folders(_json_nodes(spark, sf_dir))
    return folders.select(F.col("doc").alias("path"), F.array_join("folder", "/").alias("folder"))


def q_json_to_html(spark, sf_dir):
    html = render_documents(items_from_json(_json_nodes(spark, sf_dir)), fmt="html", escape=True)
    tree = parse_bookmarks(html.select(F.col("doc").alias("path"), F.col("text").alias("html")), doc="path")
    return tree.links.select(
        "path",
        decode_entities(F.array_join("folder", "/")).alias("folder"),
        decode_entities("url").alias("url"),
        decode_entities("title").alias("title"),
    )


def _json_counts(spark, sf_dir):
    docs = fixture_documents(_pages(spark, sf_dir), "json")
    links = json_links(flatten_json(docs, doc="path", js="text")).withColumnRenamed("doc", "path")
    return dedup.link_counts(docs.select("path"), links, file_col="path")


def q_link_counts(spark, sf_dir):
    return _json_counts(spark, sf_dir)


CONVERT_DIR = "/converted"


def q_smart_names(spark, sf_dir):
    return naming.smart_names(_json_counts(spark, sf_dir)).select("path", "n_links", "target_dir", "target_path")


def q_smart_names_o(spark, sf_dir):
    named = naming.smart_names(_json_counts(spark, sf_dir), output_dir=CONVERT_DIR)
    return named.select("path", "n_links", "target_dir", "target_path")


def q_stem_names(spark, sf_dir):
    docs = fixture_documents(_pages(spark, sf_dir), "json").select("path")
    return naming.stem_names(docs).select("path", "target_dir", "target_path")


def q_stem_names_o(spark, sf_dir):
    docs = fixture_documents(_pages(spark, sf_dir), "json").select("path")
    return naming.stem_names(docs, output_dir=CONVERT_DIR).select("path", "target_dir", "target_path")


def q_stem_names_free(spark, sf_dir):
    """Plain names that look like numbered ones (Bookmarks_<id>) beside many equal names in one folder."""
    lookalike = F.regexp_replace("path", r"/p([0-9]+)\.json$", "/Bookmarks_$1.json")
    docs = fixture_documents(_pages(spark, sf_dir), "json").select(F.when(F.col("page_id") % 3 == 1, lookalike).otherwise(F.col("path")).alias("path"))
    return naming.free_names(naming.stem_names(docs, output_dir=CONVERT_DIR), "path").select("path", "target_path")


# ---------------------------------------------------------------- written files, read back


def _scratch(spark) -> str:
    """A fresh folder that the driver and all executors see."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/io-{uuid.uuid4().hex}"


def _relative(col: str, folder: str):
    """A path below the folder."""
    return F.substring_index(F.col(col), folder.rpartition("/")[2], -1)


def q_dedup_edit(spark, sf_dir):
    """The lines of flat documents (twenty pages each) after their duplicates were removed from the text."""
    links = _links(spark, sf_dir).withColumn("file_id", F.concat(F.lit("d"), F.floor(F.col("page_id") / 20).cast("string")))
    docs = flat_pieces(links).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "").alias("html"))
    docs = docs.withColumnRenamed("doc", "file_id")
    text = joined(without_links(docs, dedup.removed(links_of(tokenize(docs)), KeyOptions())))
    return text.select("file_id", F.posexplode(F.split("html", "\n")).alias("n", "line"))


def q_io_html_files(spark, sf_dir):
    """Documents written as named files in many folders, read from the top folder."""
    folder = _scratch(spark)
    docs = fixture_documents(_pages(spark, sf_dir), "html").select(F.concat(F.lit(folder), "path").alias("target_path"), "text")
    write_named_documents(docs)
    links = parse_bookmarks(read_html_files(spark, folder, recursive=True)).links
    return links.select(_relative("file_id", folder).alias("path"), F.array_join("folder", "/").alias("folder"), "url", "title")


def q_io_json_files(spark, sf_dir):
    """S3: JSON files found by two patterns, one with any folders."""
    folder = _scratch(spark)
    write_named_documents(fixture_documents(_pages(spark, sf_dir), "json").select(F.concat(F.lit(folder), "path").alias("target_path"), "text"))
    nodes = flatten_json(read_json_files(spark, [f"{folder}/**/Bookmarks", f"{folder}/exports/*/*/*.json"]))
    return json_links(nodes).select(_relative("doc", folder).alias("path"), F.array_join("folder", "/").alias("folder"), "url", "title")


def q_io_json_splits(spark, sf_dir):
    """The same files, each read in splits of 4 KB."""
    folder = _scratch(spark)
    write_named_documents(fixture_documents(_pages(spark, sf_dir), "json").select(F.concat(F.lit(folder), "path").alias("target_path"), "text"))
    links = json_links(flatten_json_splits(json_targets(spark, [f"{folder}/**/Bookmarks", f"{folder}/exports/*/*/*.json"]).files, split=4096))
    return links.select(_relative("doc", folder).alias("path"), F.array_join("folder", "/").alias("folder"), "url", "title")


def _flat_files(spark, sf_dir) -> str:
    """The three files of the fixture, each written by many tasks."""
    folder = _scratch(spark)
    pieces = flat_pieces(_links(spark, sf_dir)).withColumn("target_path", F.concat(F.lit(f"{folder}/in/"), "doc", F.lit(".html")))
    write_named_pieces(pieces, ["k"])
    return folder


def q_io_dedup_files(spark, sf_dir):
    """Both batch modes; the tables and the files that the job writes, read back."""
    folder = _flat_files(spark, sf_dir)
    jobs.dedup_files(spark, f"{folder}/in", KeyOptions(), batch_mode="all", output=f"{folder}/kept", html_output_dir=f"{folder}/out")
    name = F.regexp_extract("file_id", "([^/]*)$", 1)
    files = parse_bookmarks(read_html_files(spark, f"{folder}/out")).links.select(F.lit("file").alias("kind"), name.alias("name"), "url", "title")
    mode = F.concat(F.regexp_replace(name, r"\.html$", ".dedup-"), "mode", F.lit(".html"))
    return files.unionByName(spark.read.parquet(f"{folder}/kept").select(F.lit("table").alias("kind"), mode.alias("name"), "url", "title"))


def _io_report(reader: str, parser: str):
    def q(spark, sf_dir):
        """The report on all files, written by kind and read back."""
        folder = _flat_files(spark, sf_dir)
        files = [f"{folder}/in/{f}.html" for f in ("f0", "f1", "f2")]
        jobs.compare_files(spark, files, CompareOptions(decode=True), output=f"{folder}/report", reader=reader, parser=parser)
        report = spark.read.parquet(f"{folder}/report")
        return report.select("item_kind", "section", F.regexp_extract("file_id", r"([^/]*)\.html$", 1).alias("file_id"), "key_url", "url", "title", "n_files")

    return q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        "fixture_links": q_fixture_links,
        "extract_links": q_extract_links,
        "pages_dedup": q_pages_dedup,
        "pages_presence": q_pages_presence,
        "entity_decode": q_entity_decode,
        "entity_decode_pages": q_entity_decode_pages,
        "entity_decode_long": q_entity_decode_long,
        "extract_quoted": q_extract_quoted,
        "extract_quoted_tolerant": q_extract_quoted_tolerant,
        "extract_irregular": q_extract_irregular,
        "extract_irregular_tolerant": q_extract_irregular_tolerant,
        "percent_decode": q_percent_decode,
        "filter_protocol": q_filter_protocol,
        "dedup_removed": q_dedup_removed,
        "presence": q_presence,
    }
    for name, opts in DEDUP_VARIANTS.items():
        out[name] = _dedup_query(opts)
    for name, (mode, opts) in BATCH_VARIANTS.items():
        out[name] = _batch_query(mode, opts)
    out["diff_a_only"] = q_diff_a_only
    out["diff_b_only"] = q_diff_b_only
    for name, (opts, kinds) in DIFF_VARIANTS.items():
        out[name] = _diff_query(opts, kinds)
    for name, (opts, kinds) in MULTI_VARIANTS.items():
        out[name] = _multi_query(opts, kinds)
    for name, opts in OWN_FOLDER_VARIANTS.items():
        out[name] = _own_folder_query(opts)
    out.update(
        html_roundtrip=q_html_roundtrip,
        html_roundtrip_tolerant=q_html_roundtrip_tolerant,
        extract_tolerant=q_extract_tolerant,
        folder_list=q_folder_list,
        json_roundtrip=q_json_roundtrip,
        json_folder_list=q_json_folder_list,
        json_to_html=q_json_to_html,
        link_counts=q_link_counts,
        smart_names=q_smart_names,
        smart_names_o=q_smart_names_o,
        stem_names=q_stem_names,
        stem_names_o=q_stem_names_o,
        stem_names_free=q_stem_names_free,
        dedup_edit=q_dedup_edit,
        io_html_files=q_io_html_files,
        io_json_files=q_io_json_files,
        io_json_splits=q_io_json_splits,
        io_dedup_files=q_io_dedup_files,
        io_report=_io_report("whole", "regex"),
        io_report_splits=_io_report("splits", "regex"),
        io_report_pieces=_io_report("splits", "html.parser"),
    )
    out.update(_LLM_QUERIES)
    return {name: _shipped(f) for name, f in out.items()}


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package made importable in the session's workers first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


# ---------------------------------------------------------------- oracle SQL
# The links fixture exactly as FIXTURES.md section 2 writes it for DuckDB.

_ANCHORS_SQL = """
select page_id, url, i-1 as pos,
       regexp_extract(a, 'href="([^"]*)"', 1) as href,
       regexp_extract(a, '>(.*?)</a>', 1) as t
from (select page_id, url, unnest(range(1, len(l)+1)) as i, unnest(l) as a
      from (select page_id, url,
                   regexp_extract_all(html, '<a href="[^"]*">.*?</a>', 0) as l
            from pages))
"""

_LINKS_SQL = f"""
select page_id*1000+pos as link_id,
  concat('f', cast((page_id*page_id+3*pos) % 1009 % 3 as varchar(9))) as file_id,
  concat('Bar/', regexp_extract(url,'^https?://[^/]+/([a-z][a-z])/',1),
    case when pos%2=0 then concat('/', regexp_extract(url,'example[.]([a-z]+)',1)) else '' end,
    case when page_id%50=7 then '/only' else '' end) as folder,
  case v when 0 then 'javascript:void(0)'
         when 1 then concat('ftp://example.com', href)
  else concat(regexp_extract(url,'^(https?)',1), '://example.com',
    case when v in (2,3) then concat(href,'/')
         when v in (4,5) then replace(replace(href,'e','%65'),'é','%C3%A9')
         when v in (6,7) then concat(href,'?a=1&amp;b=2')
         when v in (8,9) then concat(href,'?a=1&b=2')
         when v = 10 then concat(href,'?q=a+b%zz')
         else href end) end as url,
  case when page_id*page_id%7 < 2 then concat(t,' &amp; co')
       when page_id*page_id%7 = 2 then concat(t,' & co')
       else t end as title,
  page_id
from (select *, (page_id*page_id+pos*17)%101%16 as v from ({_ANCHORS_SQL}) q) z
"""

_WITH_LINKS = f"with links as ({_LINKS_SQL})\n"
_LINK_COLS_SQL = ", ".join(LINK_COLS)


def _ent(x: str) -> str:
    # The fixture holds only these four entities (FIXTURES.md section 1).
    return f"replace(replace(replace(replace({x},'&quot;','\"'),'&copy;','©'),'&middot;','·'),'&amp;','&')"


def _url_key_sql(o: KeyOptions, col: str = "url") -> str:
    u = col
    if o.profile == "v3" or o.decode:
        u = _ent(u)
    if o.decode:
        u = f"url_decode({u})"
    if not o.strict_protocol:
        u = f"regexp_replace({u}, '^https?://', '//')"
    if o.ignore_slash:
        u = f"regexp_replace({u}, '/+$', '')"
    return u


def _title_key_sql(o: KeyOptions, col: str = "title") -> str:
    if o.mode != "url-title":
        return "''"
    return _ent(col) if (o.profile in ("v2", "v3") or o.decode) else col


def _dedup_sql(o: KeyOptions) -> str:
    return (
        _WITH_LINKS
        + f"""select {_LINK_COLS_SQL}, key_url, key_title from (
  select *, row_number() over (partition by file_id, key_url, key_title order by link_id) as rn
  from (select *, {_url_key_sql(o)} as key_url, {_title_key_sql(o)} as key_title from links) k) r
where rn = 1"""
    )


def _batch_sql(mode: str, o: KeyOptions) -> str:
    modes = {"url": ["url"], "url-title": ["url-title"], "all": ["url", "url-title"]}[mode]
    arms = []
    for m in modes:
        om = o.with_mode(m)
        arms.append(
            f"select *, '{m}' as mode, {_url_key_sql(om)} as key_url, {_title_key_sql(om)} as key_title from links"
        )
    union = "\n  union all\n  ".join(arms)
    return (
        _WITH_LINKS
        + f"""select {_LINK_COLS_SQL}, mode, key_url, key_title from (
  select *, row_number() over (partition by file_id, mode, key_url, key_title order by link_id) as rn
  from ({union}) k) r
where rn = 1"""
    )


def _compare_key_sql(c: CompareOptions) -> tuple[str, str]:
    o = c.key_options()
    return _url_key_sql(o), _title_key_sql(o)


_NULL = "cast(null as varchar)"
# every folder prefix of every link, with the link's position
_FOLDER_ROWS_SQL = """folder_rows as (
  select file_id, link_id as pos, array_to_string(parts[1:n], '/') as folder
  from (select file_id, link_id, parts, unnest(generate_series(1, len(parts))) as n
        from (select file_id, link_id, string_split(folder, '/') as parts from links) s) p)"""
_FOLDERS_SQL = """folders as (
  select distinct file_id, array_to_string(parts[1:n], '/') as folder
  from (select file_id, parts, unnest(generate_series(1, len(parts))) as n
        from (select file_id, string_split(folder, '/') as parts from links) s) p)"""


def _keyed_sql(c: CompareOptions, where: str = "") -> str:
    ku, kt = _compare_key_sql(c)
    conds = []
    if c.filter:
        conds.append("lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) in ('http', 'https', 'ftp')")
    if where:
        conds.append(where)
    w = ("where " + " and ".join(conds)) if conds else ""
    return f"""keyed as (select *, {ku} as key_url, {kt} as key_title from links {w}),
reps as (select * from (select *, row_number() over (
    partition by file_id, key_url, key_title order by link_id) as rn from keyed) x where rn = 1)"""


def _multi_sql(c: CompareOptions, kinds) -> str:
    n = "1" if c.analysis == "unique" else "(select count(distinct file_id) from links)"
    parts = []
    if "bookmark" in kinds:
        file_expr = "file_id" if c.analysis == "unique" else _NULL
        parts.append(f"""select 'bookmark' as item_kind, '{c.analysis}' as section, {file_expr} as file_id,
  key_url, key_title, url, title, folder, n_files
from (select *, count(*) over (partition by key_url, key_title) as n_files,
        row_number() over (partition by key_url, key_title order by file_id, link_id) as rk from reps) b
where rk = 1 and n_files = {n}""")
    if "folder" in kinds and c.folder_key == "name":
        # one row per name: the first (file, link, path) holding it
        file_expr = "file_id" if c.analysis == "unique" else _NULL
        parts.append(f"""select 'folder' as item_kind, '{c.analysis}' as section, {file_expr} as file_id,
  {_NULL} as key_url, {_NULL} as key_title, {_NULL} as url, {_NULL} as title, folder, n_files
from (select *, count(*) over (partition by name) as n_files,
        row_number() over (partition by name order by file_id, pos, folder) as rk
      from (select file_id, name, min(struct_pack(p := pos, f := folder)).p as pos,
                   arg_min(folder, struct_pack(p := pos, f := folder)) as folder
            from (select file_id, folder, pos, split_part(folder, '/', -1) as name from folder_rows) a
            group by file_id, name) b) c
where rk = 1 and n_files = {n}""")
    elif "folder" in kinds:
        file_expr = "min(file_id)" if c.analysis == "unique" else _NULL
        parts.append(f"""select 'folder' as item_kind, '{c.analysis}' as section, {file_expr} as file_id,
  {_NULL} as key_url, {_NULL} as key_title, {_NULL} as url, {_NULL} as title, folder, count(*) as n_files
from folders group by folder having count(*) = {n}""")
    body = "\nunion all\n".join(parts)
    return f"with links as ({_LINKS_SQL}),\n{_FOLDERS_SQL},\n{_FOLDER_ROWS_SQL},\n{_keyed_sql(c)}\n{body}"


def _diff_sql(c: CompareOptions, kinds) -> str:
    a, b = FILE_A, FILE_B
    parts = []
    if "bookmark" in kinds:
        parts.append(f"""select 'bookmark' as item_kind, case when in_a then 'a_only' else 'b_only' end as section,
  r.file_id, g.key_url, g.key_title, r.url, r.title, r.folder, cast(1 as bigint) as n_files
from (select key_url, key_title, bool_or(file_id = '{a}') as in_a, bool_or(file_id = '{b}') as in_b
      from keyed group by key_url, key_title) g
join (select * from (select *, row_number() over (partition by key_url, key_title
        order by case when file_id = '{a}' then 0 else 1 end, link_id) as rk from keyed) x where rk = 1) r
  on r.key_url = g.key_url and r.key_title = g.key_title
where in_a <> in_b""")
    if "folder" in kinds:
        parts.append(f"""select 'folder' as item_kind, case when in_a then 'a_only' else 'b_only' end as section,
  f as file_id, {_NULL} as key_url, {_NULL} as key_title, {_NULL} as url, {_NULL} as title, folder,
  cast(1 as bigint) as n_files
from (select folder, bool_or(file_id = '{a}') as in_a, bool_or(file_id = '{b}') as in_b, min(file_id) as f
      from folders where file_id in ('{a}', '{b}') group by folder) g
where in_a <> in_b""")
    body = "\nunion all\n".join(parts)
    keyed = _keyed_sql(c, f"file_id in ('{a}', '{b}')")
    return f"with links as ({_LINKS_SQL}),\n{_FOLDERS_SQL},\n{keyed}\n{body}"


def _only_in_sql(a: str, b: str, section: str) -> str:
    return f"""with links as ({_LINKS_SQL}),
{_keyed_sql(CompareOptions(), f"file_id in ('{a}', '{b}')")}
select 'bookmark' as item_kind, '{section}' as section, file_id, key_url, key_title, url, title, folder,
  cast(1 as bigint) as n_files
from reps r where file_id = '{a}' and not exists (
  select 1 from keyed k where k.file_id = '{b}' and k.key_url = r.key_url and k.key_title = r.key_title)"""


_PAGE_FOLDERS_SQL = """page_folders as (
  select distinct page_id, array_to_string(parts[1:n], '/') as folder
  from (select page_id, parts, unnest(generate_series(1, len(parts))) as n
        from (select page_id, string_split(folder, '/') as parts from links) s) p)"""

_JSON_PATHS_SQL = """paths as (
  select page_id, case when page_id % 3 = 0
      then concat(b, cast(page_id as varchar), '/Bookmarks')
      else concat(b, 'p', cast(page_id as varchar), '.json') end as path
  from (select page_id, concat('/exports/', regexp_extract(url, '^https?://[^/]+/([a-z][a-z])/', 1), '/',
                regexp_extract(url, '^https?://([^/:]+)', 1), '/') as b from pages) x)"""

_COUNTS_SQL = f"""with links as ({_LINKS_SQL}),
{_JSON_PATHS_SQL},
counts as (select p.path, cast(count(l.link_id) as bigint) as n_links
           from paths p left join links l on l.page_id = p.page_id group by p.path)"""

_PARENT_SQL = "regexp_extract(path, '^(.*)/[^/]*$', 1)"


def _smart_sql(output_dir: str | None) -> str:
    tdir = f"'{output_dir}'" if output_dir else _PARENT_SQL
    return (
        _COUNTS_SQL
        + f"""
select path, n_links, target_dir, concat(target_dir, '/bookmarks_', cast(n_links as varchar),
    case when rn > 1 then concat('_', cast(rn as varchar)) else '' end, '.html') as target_path
from (select *, row_number() over (partition by target_dir, n_links order by path) as rn
      from (select *, {tdir} as target_dir from counts) c) r"""
    )


def _stem_sql(output_dir: str | None) -> str:
    tdir = f"'{output_dir}'" if output_dir else _PARENT_SQL
    return f"""with {_JSON_PATHS_SQL}
select path, target_dir, concat(target_dir, '/',
    regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^(.+?)(\\.[^.]*)?$', 1), '.html') as target_path
from (select path, {tdir} as target_dir from paths) t"""


# equal names get the least numbers from 2 on that no plain name has
_STEM_FREE_SQL = f"""with {_JSON_PATHS_SQL},
renamed as (select page_id, case when page_id % 3 = 1 then regexp_replace(path, '/p([0-9]+)[.]json$', '/Bookmarks_\\1.json') else path end as path from paths),
named as (select path, concat('{CONVERT_DIR}/', regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^(.+?)(\\.[^.]*)?$', 1), '.html') as target from renamed),
placed as (select *, row_number() over (partition by target order by path) as n from named),
free as (select k, row_number() over (order by k) as n from (select unnest(range(2, (select 4 * count(*) + 4 from pages))) as k) s
         where k not in (select page_id from pages where page_id % 3 = 1))
select p.path, case when p.n = 1 then p.target else concat('{CONVERT_DIR}/Bookmarks_', cast(f.k as varchar), '.html') end as target_path
from placed p left join free f on f.n = p.n - 1"""

# head, the lines of kept links with their notes, all rules, end
_DEDUP_EDIT_SQL = f"""with links as ({_LINKS_SQL}),
docs as (select *, concat('d', cast(page_id // 20 as varchar)) as doc from links),
marked as (select *, row_number() over (partition by doc, {_url_key_sql(KeyOptions())} order by link_id) = 1 as kept from docs),
lines as (
  select doc, link_id as k, 0 as part, concat('    <DT><A HREF="', url, '" ADD_DATE="', cast(link_id as varchar), '">', title, '</A>') as line from marked where kept
  union all select doc, link_id, 1, concat('    <DD>note ', cast(link_id as varchar)) from marked where kept and link_id % 3 = 0
  union all select doc, link_id, 2, '    <HR>' from marked where link_id % 5 = 0
  union all select d.doc, -1, h.i, h.line from (select distinct doc from docs) d,
    (select unnest(range({len(FLAT_HEAD.splitlines())})) as i, unnest([{", ".join("'" + x.replace("'", "''") + "'" for x in FLAT_HEAD.splitlines())}]) as line) h
  union all select d.doc, 4611686018427387904, e.i, e.line from (select distinct doc from docs) d,
    (select unnest(range(3)) as i, unnest([{", ".join("'" + x + "'" for x in FLAT_END.split(chr(10)))}]) as line) e)
select doc as file_id, cast(row_number() over (partition by doc order by k, part) - 1 as integer) as n, line from lines"""

_ANCHOR_RE = r"(?is)<a\b[^>]*>.*?</a\s*>"
_HREF_RE = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def oracle_sql() -> dict[str, str]:
    ku, kt = _compare_key_sql(CompareOptions())
    href_re = _HREF_RE.replace("'", "''")
    out = {
        "fixture_links": _WITH_LINKS + f"select {_LINK_COLS_SQL} from links",
        "extract_links": f"""
select file_id, pos, url, title from (
  select cast(page_id as varchar) as file_id, i - 1 as pos,
    concat(regexp_extract(st, '{href_re}', 1), regexp_extract(st, '{href_re}', 2),
           regexp_extract(st, '{href_re}', 3)) as url,
    regexp_replace(regexp_extract(a, '(?is)^<a\\b[^>]*>(.*?)</a\\s*>$', 1), '<[^>]*>', '', 'g') as title
  from (select page_id, i, a, regexp_extract(a, '(?is)^(<a\\b[^>]*>)', 1) as st
        from (select page_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as a
              from (select page_id, regexp_extract_all(html, '{_ANCHOR_RE}', 0) as l from pages))))
where url <> ''""",
        "entity_decode": _WITH_LINKS
        + f"select link_id, {_ent('url')} as url_text, {_ent('title')} as title_text from links",
        "entity_decode_pages": f"select page_id, {_ent('html')} as text from pages",
        "percent_decode": _WITH_LINKS + "select link_id, url_decode(url) as url_decoded from links",
        "filter_protocol": _WITH_LINKS
        + """select link_id, file_id, scheme from (
  select *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as scheme from links)
where scheme in ('http', 'https', 'ftp')""",
        "dedup_removed": _WITH_LINKS
        + f"""select {_LINK_COLS_SQL}, key_url, kept_pos from (
  select *, min(link_id) over (partition by file_id, key_url) as kept_pos
  from (select *, {_url_key_sql(KeyOptions())} as key_url from links) k) r
where link_id <> kept_pos""",
        "presence": _WITH_LINKS
        + f"""select key_url, key_title, count(distinct file_id) as n_files
from (select file_id, {ku} as key_url, {kt} as key_title from links) k
group by key_url, key_title""",
    }
    # The tolerant parser must give what the regex gives on these pages.
    out["extract_tolerant"] = out["extract_links"]
    page_links = f"with page_links as ({out['extract_links']})\n"
    out["pages_dedup"] = page_links + f"""select file_id, pos, url, title, key_url from (
  select *, row_number() over (partition by file_id, key_url order by pos) as rn
  from (select *, {_url_key_sql(KeyOptions())} as key_url from page_links) k) r
where rn = 1"""
    pk = CompareOptions(mode="url-title").key_options()
    out["pages_presence"] = page_links + f"""select key_url, key_title, count(distinct file_id) as n_files
from (select file_id, {_url_key_sql(pk)} as key_url, {_title_key_sql(pk)} as key_title from page_links) k
group by key_url, key_title"""
    for name, o in DEDUP_VARIANTS.items():
        out[name] = _dedup_sql(o)
    for name, (mode, o) in BATCH_VARIANTS.items():
        out[name] = _batch_sql(mode, o)
    out["diff_a_only"] = _only_in_sql(FILE_A, FILE_B, "a_only")
    out["diff_b_only"] = _only_in_sql(FILE_B, FILE_A, "b_only")
    for name, (c, kinds) in DIFF_VARIANTS.items():
        out[name] = _diff_sql(c, kinds)
    for name, (c, kinds) in MULTI_VARIANTS.items():
        out[name] = _multi_sql(c, kinds)
    own = f"""select * replace (case when link_id % 7 = 0 then concat(folder, '/own ', file_id) else folder end as folder)
from ({_LINKS_SQL}) l"""
    for name, c in OWN_FOLDER_VARIANTS.items():
        out[name] = _multi_sql(c, ("folder",)).replace(f"with links as ({_LINKS_SQL})", f"with links as ({own})")
    # nothing around the links changes them
    out["extract_irregular"] = out["extract_irregular_tolerant"] = out["extract_links"]
    out["extract_quoted"] = out["extract_quoted_tolerant"] = f"""select file_id, pos, concat('{QUOTED}', url) as url, title
from ({out['extract_links']}) l"""
    out["entity_decode_long"] = _WITH_LINKS + f"""select link_id, concat({_ent('url')}, '&&x', chr(65533), chr(233)) as url_text
from links"""
    json_links_sql = f"""with links as ({_LINKS_SQL}),
{_JSON_PATHS_SQL}
select p.path, concat('Bookmarks bar/', l.folder) as folder, l.url, l.title
from links l join paths p on p.page_id = l.page_id"""
    out.update(
        html_roundtrip=_WITH_LINKS + "select cast(page_id as varchar) as file_id, folder, url, title from links",
        html_roundtrip_tolerant=_WITH_LINKS
        + "select cast(page_id as varchar) as file_id, folder, url, title from links",
        folder_list=f"with links as ({_LINKS_SQL}),\n{_PAGE_FOLDERS_SQL}\n"
        "select cast(page_id as varchar) as file_id, folder from page_folders",
        json_roundtrip=json_links_sql,
        json_to_html=json_links_sql,
        json_folder_list=f"""with links as ({_LINKS_SQL}),
{_PAGE_FOLDERS_SQL},
{_JSON_PATHS_SQL}
select p.path, 'Bookmarks bar' as folder from paths p
union all
select p.path, concat('Bookmarks bar/', f.folder) as folder from page_folders f join paths p on p.page_id = f.page_id""",
        link_counts=_COUNTS_SQL + "\nselect path, n_links from counts",
        smart_names=_smart_sql(None),
        smart_names_o=_smart_sql(CONVERT_DIR),
        stem_names=_stem_sql(None),
        stem_names_o=_stem_sql(CONVERT_DIR),
        stem_names_free=_STEM_FREE_SQL,
        dedup_edit=_DEDUP_EDIT_SQL,
        io_html_files=_WITH_LINKS
        + """select concat('/exports/', regexp_extract(p.url, '^https?://[^/]+/([a-z][a-z])/', 1), '/',
    regexp_extract(p.url, '^https?://([^/:]+)', 1), '/p', cast(p.page_id as varchar), '.html') as path, l.folder, l.url, l.title
from links l join pages p on p.page_id = l.page_id""",
        io_json_files=json_links_sql,
        io_json_splits=json_links_sql,
        io_dedup_files=f"""with kept as ({_batch_sql('all', KeyOptions())})
select kind, concat(file_id, '.dedup-', mode, '.html') as name, url, title from kept, (values ('file'), ('table')) k(kind)""",
    )
    report = f"""with links as ({_LINKS_SQL}),
{_keyed_sql(CompareOptions(decode=True))}
select 'bookmark' as item_kind, 'unique' as section, file_id, key_url, url, title, n_files
from (select *, count(*) over (partition by key_url) as n_files from reps) b where n_files = 1"""
    out.update(dict.fromkeys(("io_report", "io_report_splits", "io_report_pieces"), report))
    out.update(_LLM_SQL)
    return out
