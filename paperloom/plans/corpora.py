"""Test corpora derived from the driver tables by plain SQL that Spark and DuckDB read alike.

Names in braces are tables or other corpora.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..functions.staging import stage

CORPORA: dict[str, str] = {}

CORPORA["deals"] = """
SELECT o_orderkey AS k, c_mktsegment AS seg, n_name AS nat
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""

CORPORA["lines"] = """
SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS l_linenumber FROM {lineitem}"""

CORPORA["demands"] = """
SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS line, l_returnflag AS flag, l_linestatus AS status,
  '资格要求 ' || CAST(l_linenumber AS STRING) || ' ' || l_returnflag || ' 承诺 ' || CAST(l_partkey AS STRING) AS text
FROM {lines}"""


def _node(prefix: str, pos: int, kind: str, text: str, source: str = "{deals}", where: str = "") -> str:
    return f"SELECT '{prefix}' || CAST(k AS STRING) AS doc_id, CAST({pos} AS BIGINT) AS pos, 'p-{pos}' AS node_id, '{kind}' AS kind, {text} AS text FROM {source}{' WHERE ' + where if where else ''}"


_S = "CAST({} AS STRING)".format
CORPORA["tender_nodes"] = " UNION ALL ".join(
    [
        _node("T", 0, "heading", "'招标公告 ' || " + _S("k")),
        _node("T", 1, "paragraph", "'项目编号：ORD-' || " + _S("k")),
        _node("T", 2, "paragraph", "'项目名称：' || seg || ' PROJECT ' || " + _S("k % 5")),
        _node("T", 3, "paragraph", "'标段名称：SECTION ' || " + _S("k % 7")),
        _node("T", 4, "paragraph", "'工期：' || " + _S("30 + k % 60") + " || '天'"),
        _node("T", 5, "paragraph", "'质量标准：GRADE ' || " + _S("k % 5")),
        _node("T", 6, "paragraph", "'招标人：' || nat"),
        _node("T", 7, "heading", "'投标文件格式 ' || " + _S("k % 3"), where="k % 2 = 0"),
        "SELECT 'T' || CAST(k AS STRING) AS doc_id, 10 + line AS pos, 'p-' || CAST(10 + line AS STRING) AS node_id, 'paragraph' AS kind, text FROM {demands}",
    ]
)
CORPORA["bid_nodes"] = " UNION ALL ".join(
    [
        _node("B", 0, "heading", "'投标书 ' || " + _S("k")),
        _node("B", 1, "paragraph", "'投标人：BIDDER ' || " + _S("k % 97")),
        _node("B", 2, "paragraph", "'投标单位：BIDDER X' || " + _S("k % 97"), where="k % 19 = 0"),
        _node("B", 3, "paragraph", "'项目编号：ORD-' || " + _S("k + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END")),
        _node("B", 4, "paragraph", "'项目名称：' || CASE WHEN k % 3 = 0 THEN lower(seg) ELSE seg END || '  PROJECT ' || " + _S("k % 5")),
        _node("B", 5, "paragraph", "'标段名称：SECTION ' || " + _S("k % 7")),
        _node("B", 6, "paragraph", "'工期：' || " + _S("30 + k % 60 + CASE WHEN k % 13 = 0 THEN 5 ELSE 0 END") + " || '天'"),
        _node("B", 7, "paragraph", "'服务期：99天'", where="k % 23 = 0"),
        _node("B", 8, "paragraph", "'质量标准：GRADE ' || " + _S("k % 5"), where="k % 17 <> 0"),
        _node("B", 9, "paragraph", "'招标人：' || nat", where="k % 7 = 0"),
        "SELECT 'B' || CAST(k AS STRING) AS doc_id, 10 + line AS pos, 'p-' || CAST(10 + line AS STRING) AS node_id, 'paragraph' AS kind, text || CASE WHEN status = 'O' AND line % 3 = 0 THEN ' ____' ELSE '' END AS text FROM {demands} WHERE flag <> 'R'",
    ]
)
CORPORA["pairs"] = """
SELECT 'P' || CAST(k AS STRING) AS pair_id, 'T' || CAST(k AS STRING) AS tender_id, 'B' || CAST(k AS STRING) AS bid_id,
  CASE WHEN k % 3 = 0 THEN 'bidder ' ELSE 'BIDDER ' END || CAST(k % 97 AS STRING) AS bidder_name FROM {deals}"""
CORPORA["benchmark_required"] = "SELECT 'bench' AS doc_id, CAST(item_id AS BIGINT) AS pos, 'b-' || CAST(item_id AS STRING) AS node_id, text FROM {benchmark}"
CORPORA["bid_langs"] = "SELECT lang AS doc_id, CAST(doc_id AS BIGINT) AS pos, text FROM {documents}"
CORPORA["lang_pairs"] = "SELECT DISTINCT lang AS pair_id, 'bench' AS tender_id, lang AS bid_id FROM {documents}"

# templates: one document per brand and range of 5000 part keys, so that documents stay small; headings, label cells and blanks from parts
CORPORA["template_nodes"] = """
SELECT p_brand || '-' || CAST(CAST(floor(p_partkey / 5000) AS BIGINT) AS STRING) AS doc_id, row_number() OVER (PARTITION BY p_brand, floor(p_partkey / 5000) ORDER BY p_partkey, step) - 1 AS pos,
  CASE WHEN step = 2 THEN 'cell-0-' || CAST(p_partkey AS STRING) || '-0' WHEN step = 3 THEN 'cell-0-' || CAST(p_partkey AS STRING) || '-1'
       ELSE 'p-' || CAST(p_partkey AS STRING) || '-' || CAST(step AS STRING) END AS node_id,
  CASE step WHEN 0 THEN 'heading' WHEN 2 THEN 'cell' WHEN 3 THEN 'cell' WHEN 5 THEN CASE WHEN p_partkey % 6 = 0 THEN 'footer' ELSE 'paragraph' END ELSE 'paragraph' END AS kind,
  CASE WHEN step = 0 THEN 1 + p_size % 3 END AS level,
  CASE step
    WHEN 0 THEN CASE p_partkey % 4 WHEN 0 THEN '资格审查 ' ELSE '章节 ' END || CAST(p_partkey AS STRING)
    WHEN 1 THEN CASE p_partkey % 5 WHEN 0 THEN '地址：____' WHEN 1 THEN '联系电话：待填写' WHEN 2 THEN '规格' || CAST(p_size AS STRING) || '：____' ELSE '说明 ' || p_type END
    WHEN 2 THEN CASE p_partkey % 3 WHEN 0 THEN '邮箱' ELSE '型号' || CAST(p_size AS STRING) END
    WHEN 3 THEN CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '____' ELSE p_name END
    WHEN 4 THEN CASE p_partkey % 7 WHEN 0 THEN '【请插入：图片】 [[签章]]' WHEN 1 THEN '【请插入证照】' ELSE '内容 ' || p_name END
    ELSE CASE p_partkey % 3 WHEN 0 THEN ' ' ELSE '备注 ' || p_type END END AS text
FROM {part} CROSS JOIN (SELECT 0 AS step UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) s"""

# metadata: one document per nation
CORPORA["occurrences_src"] = """
SELECT 'D' || CAST(c_nationkey AS STRING) AS doc_id, part, CAST(c_custkey AS STRING) || '/' || f AS locator, c_custkey AS pos, field, original_value, value_type, replacement_kind, category,
  CASE WHEN field IN ('core:created', 'app:Pages') THEN 'preserve' ELSE 'randomize' END AS spec_action, CAST(c_custkey AS BIGINT) AS ck
FROM (
  SELECT *, 'docProps/core.xml' AS part, 'creator' AS f, 'core:creator' AS field, substr(c_name, 1, 16) || CAST(c_custkey % 40 AS STRING) AS original_value, 'string' AS value_type, 'person' AS replacement_kind, 'person-identity' AS category FROM {customer}
  UNION ALL SELECT *, 'docProps/app.xml', 'company', 'app:Company', c_mktsegment, 'organization', 'organization', 'organization' FROM {customer}
  UNION ALL SELECT *, 'docProps/core.xml', 'revision', 'core:revision', CASE WHEN c_custkey % 29 = 0 THEN 'n/a' ELSE CAST(c_custkey % 13 AS STRING) END, 'integer', 'integer', 'document-identifier' FROM {customer}
  UNION ALL SELECT *, 'docProps/core.xml', 'created', 'core:created', '2020-01-0' || CAST(1 + c_custkey % 9 AS STRING) || 'T00:00:00Z', 'timestamp', NULL, 'timestamp' FROM {customer}
  UNION ALL SELECT *, 'docProps/app.xml', 'pages', 'app:Pages', CAST(c_custkey % 50 AS STRING), 'integer', NULL, 'application' FROM {customer}
) s"""
CORPORA["occurrences_in"] = """
SELECT doc_id, part, locator, pos, field, category, value_type, replacement_kind, original_value, ck,
  CASE WHEN value_type = 'integer' AND original_value = 'n/a' THEN 'warn' ELSE spec_action END AS action FROM {occurrences_src}"""
CORPORA["replacements"] = """
SELECT doc_id, part, locator, CASE replacement_kind WHEN 'person' THEN 'User-' || CAST(ck % 40 AS STRING) || doc_id WHEN 'organization' THEN 'Org-' || original_value ELSE CAST(100 + ck % 7 AS STRING) END AS value
FROM {occurrences_in} WHERE action = 'randomize' AND ck % 211 <> 0"""
CORPORA["occurrences_out"] = """
SELECT o.doc_id, o.part, o.locator, o.pos, o.field, o.category, o.value_type, o.replacement_kind, o.action,
  CASE WHEN o.action <> 'randomize' THEN o.original_value WHEN o.ck % 101 = 0 THEN o.original_value WHEN o.ck % 103 = 0 THEN 'User-shared' ELSE r.value END AS original_value
FROM {occurrences_in} o LEFT JOIN {replacements} r ON o.doc_id = r.doc_id AND o.part = r.part AND o.locator = r.locator
WHERE o.ck % 107 <> 0"""

# packages
CORPORA["parts_src"] = """
SELECT 'Z' || CAST(l_orderkey AS STRING) AS doc_id, CAST(l_linenumber AS INT) AS ord, 'word/part' || CAST(l_linenumber AS STRING) || '.xml' AS name,
  CAST(l_partkey AS STRING) || ':' || CAST(l_suppkey AS STRING) AS contents, l_orderkey AS k FROM {lines}"""
CORPORA["parts_out"] = """
SELECT doc_id, CASE WHEN k % 31 = 0 THEN 100 - ord ELSE ord END AS ord, CASE WHEN k % 37 = 0 AND ord = 1 THEN 'word/renamed.xml' ELSE name END AS name,
  CASE WHEN k % 41 = 0 AND ord = 2 THEN contents || '!' ELSE contents END AS contents, k FROM {parts_src} WHERE NOT (k % 43 = 0 AND ord = 3)"""
CORPORA["rels"] = """
SELECT 'Z' || CAST(l_orderkey AS STRING) AS doc_id, 'word/part' || CAST(l_linenumber AS STRING) || '.xml' AS source_part,
  CASE l_partkey % 3 WHEN 0 THEN 'part1.xml' WHEN 1 THEN '../word/part2.xml' ELSE '/word/part' || CAST(l_linenumber + 1 AS STRING) || '.xml' END AS target,
  l_suppkey % 5 = 0 AS external, CAST(l_linenumber AS STRING) AS rel_id FROM {lines}"""
CORPORA["text_items"] = """
SELECT 'I' || CAST(l_orderkey AS STRING) AS doc_id, CAST(1 + l_linenumber % 2 AS INT) AS page, CAST(l_linenumber AS INT) AS ord, CAST(l_quantity * 10 AS DOUBLE) AS x,
  CAST(CAST(floor(l_extendedprice) AS BIGINT) % 4 * 100 AS DOUBLE) AS y, 40.0 AS width, 12.0 AS height, CASE WHEN l_suppkey % 9 = 0 THEN 20.0 ELSE 10.0 END AS font_size,
  CASE l_partkey % 6 WHEN 0 THEN '1.2 ' || l_returnflag WHEN 1 THEN ' ' WHEN 2 THEN '资格审查 ' || l_returnflag ELSE 'ITEM ' || CAST(l_suppkey AS STRING) END AS text FROM {lines}"""

# tasks and logs from the event stream
CORPORA["task_events"] = """
SELECT 'U' || CAST(user_id AS STRING) AS task_id, ts, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'previewing' WHEN 'click' THEN 'awaiting-confirmation' WHEN 'purchase' THEN 'running' ELSE 'completed' END AS state,
  CASE WHEN value IS NULL THEN 0.0 WHEN value >= 100 THEN 1.0 ELSE round(value / 100.0, 3) END AS progress,
  CASE WHEN event_id % 3 = 0 THEN 'passed' WHEN event_id % 3 = 1 THEN 'failed' END AS verification_status, CASE WHEN event_id % 5 = 0 THEN 'INTERNAL' END AS error_code FROM {events}"""
CORPORA["previews"] = "SELECT 'U' || CAST(user_id AS STRING) AS task_id, CAST(event_id % 4 AS STRING) AS plan_digest, ts AS created_at, event_id AS seq, CAST(event_id % 2 AS INT) AS blockers FROM {events} WHERE event_type = 'view'"
CORPORA["confirms"] = "SELECT 'U' || CAST(user_id AS STRING) AS task_id, CAST(event_id % 4 AS STRING) AS plan_digest, ts, event_id AS seq FROM {events} WHERE event_type = 'purchase'"
CORPORA["diagnostics"] = "SELECT ts AS timestamp, 'd' || CAST(user_id % 50 AS STRING) AS detailId, event_type AS stage, 'E' || CAST(event_id % 7 AS STRING) AS code, event_id AS seq FROM {events}"
CORPORA["doc_nodes"] = "SELECT doc_id, text FROM {documents}"


def names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", sql)))


#: Corpora that many branches of others read, each a join or a window over whole tables: written once for each query.
SHARED = {"deals", "demands"}


class Inputs:
    """Tables of one data folder and the corpora made from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._seen = spark, sf_dir, {}
        self.shared = SHARED  # a query may name others

    def __call__(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in CORPORA:
                sql = CORPORA[name]
                self._seen[name] = self.spark.sql(sql, **{n: self.staged(n) if n in self.shared else self(n) for n in names_in(sql)})
            else:
                self._seen[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._seen[name]

    def staged(self, name: str) -> DataFrame:
        """A corpus that a query reads several times, written once."""
        key = f"{name} staged"
        if key not in self._seen:
            self._seen[key] = stage(self(name), name)
        return self._seen[key]


#: Corpora of the twins that are read several times and costly to work out: kept, never inlined.
KEPT = {"t_facts", "b_facts", "mismatch", "missing"}


def with_corpora(body: str, extra: dict[str, str] | None = None) -> str:
    """DuckDB query: `body` with its corpora (names in braces) as common table expressions."""
    extra = extra or {}
    order: list[str] = []

    def need(sql: str) -> None:
        for n in names_in(sql):
            text = extra.get(n) or CORPORA.get(n)
            if text and n not in order:
                need(text)
                if n not in order:
                    order.append(n)

    need(body)
    plain = lambda s: re.sub(r"\{([a-z]\w*)\}", r"\1", s)
    ctes = ", ".join(f"{n} AS {'MATERIALIZED ' * (n in KEPT)}({plain(extra.get(n) or CORPORA[n])})" for n in order)
    return f"WITH {ctes} {plain(body)}" if ctes else plain(body)


# outlines: documents with and without headings, numbered and long lines
CORPORA["outline_nodes"] = """
SELECT 'O' || CAST(o_orderkey % 400 AS STRING) AS doc_id, row_number() OVER (PARTITION BY o_orderkey % 400 ORDER BY o_orderkey) - 1 AS pos, 'p-' || CAST(o_orderkey AS STRING) AS node_id,
  CASE WHEN o_orderkey % 400 < 100 AND o_orderkey % 7 = 0 THEN 'heading' ELSE 'paragraph' END AS kind,
  CAST(CASE WHEN o_orderkey % 400 < 100 AND o_orderkey % 7 = 0 THEN 1 + o_orderkey % 4 END AS INT) AS level,
  CASE o_orderkey % 6 WHEN 0 THEN '1.2.3 ' || o_orderpriority WHEN 1 THEN '第3章 ' || o_orderpriority WHEN 2 THEN '二、' || o_orderpriority WHEN 3 THEN '本项目技术要求'
    WHEN 4 THEN 'x' ELSE o_orderpriority || ' and a long line of text that goes on and on beyond the limit of a heading' END AS text FROM {orders}"""
CORPORA["small_chunks_t"] = "SELECT doc_id, CAST(floor(pos / 4) AS INT) AS chunk_index, CAST(pos % 4 AS INT) AS piece_ord, node_id, text FROM {tender_nodes}"
CORPORA["small_chunks_b"] = "SELECT doc_id, CAST(floor(pos / 4) AS INT) AS chunk_index, CAST(pos % 4 AS INT) AS piece_ord, node_id, text FROM {bid_nodes}"
CORPORA["ai_evidence"] = """
SELECT 'F' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS finding_id, 'T' || CAST(l_orderkey AS STRING) AS doc_id,
  CAST(floor((10 + l_linenumber) / 4) AS INT) + CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END AS chunk_index, 'p-' || CAST(10 + l_linenumber AS STRING) AS node_id,
  CASE WHEN l_partkey % 5 = 0 THEN '资格要求 x' ELSE ' 承诺 ' || CAST(l_partkey AS STRING) END AS excerpt,
  '资格要求 ' || CAST(l_linenumber AS STRING) || ' ' || l_returnflag || ' 承诺 ' || CAST(l_partkey + CASE WHEN l_suppkey % 13 = 0 THEN 1 ELSE 0 END AS STRING) AS digest_of FROM {lines}"""
CORPORA["actions_table"] = """
SELECT l_orderkey AS plan_id, l_linenumber AS ord, CASE l_partkey % 4 WHEN 0 THEN 'tender-fixed' WHEN 1 THEN 'user-form' WHEN 2 THEN 'placeholder' ELSE 'unknown' END AS source,
  CASE l_partkey % 4 WHEN 2 THEN 'placeholder' ELSE 'replace' END AS action, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'v' END AS value,
  CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'image' END AS placeholder_type, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE 'n' END AS evidence_node_id FROM {lines}"""
CORPORA["checks"] = """
SELECT 'K' || CAST(l_orderkey % 200 AS STRING) AS task_id, 'Z' || CAST(l_orderkey AS STRING) AS doc_id, CAST(l_linenumber AS INT) AS ord, 'check-' || CAST(l_linenumber AS STRING) AS name,
  CASE WHEN l_partkey % 97 = 0 THEN 'failed' ELSE 'passed' END AS status FROM {lines}"""
CORPORA["reports"] = """
SELECT 'K' || CAST(o_orderkey % 230 AS STRING) AS task_id, max(CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'completed' END) AS status, min(o_orderdate) AS started_at,
  max(CASE WHEN o_orderkey % 230 % 17 = 0 THEN CAST('1990-01-01' AS TIMESTAMP) ELSE o_orderdate END) AS completed_at FROM {orders} GROUP BY o_orderkey % 230"""
CORPORA["inputs_old"] = "SELECT 'f' || CAST(c_custkey AS STRING) AS path, CAST(c_custkey % 1000 AS BIGINT) AS size, CAST(c_custkey AS DOUBLE) AS mtime_ms, c_name AS sha256 FROM {customer}"
CORPORA["inputs_now"] = """
SELECT path, size + CASE WHEN size % 10 = 3 THEN 1 ELSE 0 END AS size, mtime_ms + CASE WHEN size % 10 = 4 THEN 1 ELSE 0 END AS mtime_ms, CASE WHEN size % 10 = 5 THEN 'x' ELSE sha256 END AS sha256
FROM {inputs_old} WHERE size % 10 <> 6"""
CORPORA["dated"] = """
SELECT 'D' || CAST(o_custkey % 500 AS STRING) AS doc_id, 'randomize' AS action, CASE WHEN o_orderkey % 2 = 0 THEN 'created' ELSE 'modified' END AS date_role,
  '20' || CAST(10 + o_orderkey % 2 + (o_custkey % 2) * (1 - o_orderkey % 2) * 3 AS STRING) || '-01-01' AS original_value FROM {orders}"""
CORPORA["filled"] = "SELECT doc_id, pos AS ord, CASE WHEN pos % 13 = 5 THEN text || '?' ELSE text END AS text FROM {tender_nodes} WHERE NOT (node_id = 'p-6' AND length(doc_id) % 2 = 0)"
CORPORA["cands"] = """
SELECT doc_id, doc_id || '-' || CAST(pos AS STRING) AS candidate_id, pos AS start_pos, pos + 1 + (pos * 7) % 12 AS end_pos, CAST((pos * 5) % 9 AS INT) AS fillable_slots FROM {template_nodes} WHERE kind = 'heading'"""
CORPORA["outputs"] = "SELECT doc_id, candidate_id, '资格审查 ' || CAST(start_pos * 6 AS STRING) || ' 章节 15 说明 ECONOMY' AS text FROM {cands}"
CORPORA["wide_nodes"] = """
SELECT doc_id, text, translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789()', 'ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ０１２３４５６７８９（）') AS wide FROM {documents}"""
CORPORA["styled_nodes"] = """
SELECT 'S' || CAST(o_custkey % 100 AS STRING) AS doc_id, 'p-' || CAST(o_orderkey AS STRING) AS node_id,
  CASE o_orderkey % 7 WHEN 0 THEN 'h2' WHEN 1 THEN 'title' WHEN 2 THEN 'own' WHEN 3 THEN 'Heading7' WHEN 4 THEN 'body' WHEN 5 THEN 'Heading12' END AS style_id,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 11 END AS INT) AS outline FROM {orders}"""
CORPORA["doc_styles"] = """
SELECT DISTINCT doc_id, s.style_id, s.name, s.outline FROM {styled_nodes} CROSS JOIN (SELECT 'h2' AS style_id, '标题 2' AS name, CAST(NULL AS INT) AS outline UNION ALL SELECT 'title', 'Title', 7 UNION ALL SELECT 'own', 'Body', 4) s"""
CORPORA["zip_entries"] = """
SELECT 'Z' || CAST(l_orderkey AS STRING) AS doc_id, CASE l_partkey % 8 WHEN 0 THEN '../up' WHEN 1 THEN '/abs' WHEN 2 THEN 'C:x' WHEN 3 THEN 'a/./b' ELSE 'word/' END || CAST(l_linenumber AS STRING) AS name,
  CAST(CASE WHEN l_suppkey % 11 = 0 THEN 9 ELSE 8 END AS INT) AS flags, CAST(CASE WHEN l_suppkey % 13 = 0 THEN 41471 ELSE 33188 END AS INT) AS mode,
  CAST(CASE WHEN l_suppkey % 17 = 0 THEN 300000000 ELSE l_partkey END AS BIGINT) AS size, CAST(CASE WHEN l_suppkey % 17 = 0 THEN 200000000 WHEN l_suppkey % 19 = 0 THEN 0 ELSE l_partkey END AS BIGINT) AS compressed_size FROM {lines}"""
CORPORA["zip_names"] = """
SELECT 'Z' || CAST(l_orderkey AS STRING) AS doc_id, CASE l_linenumber WHEN 1 THEN 'Word/document.xml' WHEN 2 THEN '[Content_Types].xml'
  ELSE CASE l_partkey % 9 WHEN 0 THEN 'word/vbaProject.bin' WHEN 1 THEN '_xmlsignatures/sig1.xml' ELSE 'word/x' || CAST(l_linenumber AS STRING) END END AS name FROM {lines}"""
CORPORA["log_lines"] = """
SELECT event_id AS seq, user_id % 13 = 0 AS broken, event_type AS stage, 'd' || CAST(user_id % 50 AS STRING) AS detail_id FROM {events}"""
CORPORA["doc_xml"] = "SELECT CAST(doc_id AS STRING) AS doc_id, source, text FROM {documents} WHERE text IS NOT NULL"


#: Packages made before they are handed on.
PACKAGES = 256


def docx_packages(docs: DataFrame) -> DataFrame:
    """doc_id and content: a small DOCX package per row of `docs(doc_id, source, text)`, its lines as paragraphs."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def package(source: str, text: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", "<Types/>")
            z.writestr("docProps/core.xml", f"<c><creator>{escape(source)}</creator><revision>3</revision><created>2020-01-01T00:00:00Z</created></c>")
            z.writestr("word/document.xml", f"<w:document {w}><w:body>" + "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in text.split("\n")) + "</w:body></w:document>")
        return out.getvalue()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in (b[x : x + PACKAGES] for x in range(0, len(b), PACKAGES)):
                yield pd.DataFrame({"doc_id": part["doc_id"], "content": [package(s or "", t) for s, t in zip(part["source"], part["text"], strict=True)]})

    return docs.select("doc_id", "source", "text").mapInPandas(run, "doc_id string, content binary")


CORPORA["office_docs"] = "SELECT CAST(doc_id AS BIGINT) AS k, source, lang, text FROM {documents} WHERE text IS NOT NULL AND doc_id IS NOT NULL"


def office_packages(docs: DataFrame, output: bool = False) -> DataFrame:
    """doc_id (`k`), content: a whole DOCX package per row of `docs(k, source, lang, text)`, or what a sanitiser made of it.

    Packages hold types, relationships, properties, styles, a header, comments and a revision; by remainders of `k` some have a
    fault in one of them, and outputs differ from their sources in more than the values of identity metadata.
    """
    o = "http://schemas.openxmlformats.org/"
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    q = {'"': "&quot;"}

    def package(k: int, source: str, lang: str, text: str) -> bytes:
        who, w = escape(source, q), f'xmlns:w="{o}wordprocessingml/2006/main"'
        new = lambda old, value: value if output else old
        type_ = "application/vnd.ms-word.document.macroEnabled.main+xml" if k % 17 == 5 else main
        signed = f'<Override PartName="/sig.bin" ContentType="application/vnd.openxmlformats-package.digital-signature-origin"/>' if k % 19 == 3 else ""  # noqa: F541
        parts = {"[Content_Types].xml": f'<Types xmlns="{o}package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{type_}"/>{signed}</Types>'}
        if k % 23 != 4:
            parts["_rels/.rels"] = f'<Relationships xmlns="{o}package/2006/relationships"><Relationship Id="r1" Type="{o}officeDocument/2006/relationships/officeDocument" Target="{"/" * (k % 2)}word/document.xml"/></Relationships>'
        revision = str(k) if k % 13 else new("n/a", "n/b")
        parts["docProps/core.xml"] = (
            f'<cp:coreProperties xmlns:cp="{o}package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/">'
            f'<dc:creator>{new(who, f"Person-{k}")}</dc:creator><cp:revision>{new(revision, "7") if k % 13 else revision}</cp:revision><dcterms:created>2020-01-01T00:00:00Z</dcterms:created><dc:title>{new(escape(lang), "Title")}</dc:title><creator>kept</creator></cp:coreProperties>'
        )
        vt = "vt:"
        parts["docProps/custom.xml"] = (
            f'<Properties xmlns="{o}officeDocument/2006/custom-properties" xmlns:vt="{o}officeDocument/2006/docPropsVTypes"><property name="a"><{vt}ui1>{new(str(k % 300), "9") if k % 300 < 256 else k % 300}</{vt}ui1></property>'
            f'<property name="b"><{vt}lpwstr>{new("own", "other")}</{vt}lpwstr></property><property name="c"><{vt}blob>x</{vt}blob></property><property name="d"/></Properties>'
        )
        body = text.replace(" the ", " thy ", 1) if output and k % 7 == 0 else text
        rows = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in body.split("\n"))
        parts["word/document.xml"] = f'<w:document {w}><w:body><w:p w:author="kept"><w:ins w:id="1" w:author="{new(who, "P")}" w:date="{new("2021-02-03T04:05:06Z", "2020-01-01T00:00:00Z")}"/></w:p>{rows}</w:body></w:document>'
        date = "bad" if k % 7 == 1 else new("2021-02-03T04:05:06Z", "2020-01-01T00:00:00Z")
        parts["word/comments.xml"] = f'<w:comments {w}><w:comment w:id="{int(output and k % 11 == 0)}" w:author="{new(who, "P")}" w:initials="{new("AB", "CD")}" w:date="{date}"><w:p/></w:comment></w:comments>'
        parts["word/header1.xml"] = f'<w:hdr {w}><w:p><w:r><w:t>{escape(lang)}</w:t></w:r></w:p></w:hdr>' + "\n" * (output and k % 5 == 2)
        if not (output and k % 10 == 3):
            parts["word/styles.xml"] = f'<w:styles {w}><w:style w:styleId="a3"><w:name w:val="heading 2"/></w:style></w:styles>'
        if output and k % 10 == 4:
            parts["customXml/item1.xml"] = "<x/>"
        target = "../../up.xml" if k % 29 == 1 else "%2e%2e/word/styles.xml" if k % 31 == 2 else "gone.xml" if k % 37 == 0 else "styles.xml" if k % 2 else "/word/styles.xml"
        kind = "digital-signature/origin" if k % 41 == 6 else "comments"
        links = [("styles", target, ""), (kind, "./comments.xml", ""), ("header", "header1.xml?x#top", ""), ("hyperlink", "https://example.org/a b", ' TargetMode="External"')]
        rels = "".join(f'<Relationship Id="r{i}" Type="{o}relationships/{a}" Target="{b}"{c}/>' for i, (a, b, c) in enumerate(links))
        ghost = "word/_rels/ghost.xml.rels" if k % 43 == 5 else "word/_rels/document.xml.rels"
        parts[ghost] = f'<Relationships xmlns="{o}package/2006/relationships">{rels}</Relationships>'
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, contents in parts.items():
                z.writestr(name, contents)
        return out.getvalue()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in (b[x : x + PACKAGES] for x in range(0, len(b), PACKAGES)):
                yield pd.DataFrame({"doc_id": part["k"].astype(str), "content": [package(int(k), s or "", x or "", t) for k, s, x, t in zip(part["k"], part["source"], part["lang"], part["text"], strict=True)]})

    return docs.select("k", "source", "lang", "text").mapInPandas(run, "doc_id string, content binary")


# files: texts under names with and without a known extension, with and without its first bytes; the digest in the name
# tells texts of one id apart, and repeated rows are one file
CORPORA["loose_files"] = """
SELECT coalesce(CAST(k AS STRING), '') || '-' || md5(coalesce(text, '')) || CASE k % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.docx' WHEN 3 THEN '.pdf' WHEN 4 THEN '.txt' WHEN 5 THEN '.PDF' ELSE '' END AS name,
  CASE WHEN k % 7 IN (0, 5) THEN '%PDF-1.7 ' WHEN k % 7 = 1 THEN 'PK' ELSE '' END || coalesce(text, '') AS body
FROM (SELECT doc_id AS k, text FROM {documents})"""


def damaged(packages: DataFrame) -> DataFrame:
    """`packages(doc_id, content)`, some of them cut in half or with a wrong byte in their last entry, by remainders of the id."""

    def spoil(k: int, content: bytes) -> bytes:
        if k % 11 == 3:
            return content[: len(content) // 2]
        if k % 11 == 5:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                e = z.infolist()[-1]
            at = e.header_offset + 30 + len(e.filename)
            return content[:at] + bytes([content[at] ^ 255]) + content[at + 1 :]
        return content

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "content": [spoil(int(k), c) for k, c in zip(b["doc_id"], b["content"], strict=True)]})

    return packages.mapInPandas(run, "doc_id string, content binary")


def write_files(rows: DataFrame, folder: str) -> int:
    """Write each row of `rows(name, content)` as a file below `folder`; returns their number.

    A file appears under its name when it is whole, so tasks that are run again leave no torn file. Names start with
    the first two digits of their hash, as folders of a bounded number of files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(folder)
        made: set[str] = set()
        for b in batches:
            for name, content in zip(b["name"], b["content"], strict=True):
                place = f"{root}/files/{uuid.uuid5(uuid.NAMESPACE_OID, name).hex[:2]}"
                if place not in made:
                    system.create_dir(place, recursive=True)
                    system.create_dir(f"{root}/unfinished", recursive=True)
                    made.add(place)
                new = f"{root}/unfinished/{uuid.uuid4().hex}"
                with system.open_output_stream(new) as f:
                    f.write(bytes(content))
                system.move(new, f"{place}/{name}")
            yield pd.DataFrame({"n": [len(b)]})

    return rows.select("name", "content").mapInPandas(run, "n long").groupBy().sum("n").first()[0] or 0
