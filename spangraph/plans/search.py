"""Keyword, vector and fused search; text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import cosine_distance
from ..operators import search as se
from ..operators.structure import folder_tree, markdown_sections
from ..operators.windows import best_per_key, summed_best
from ..runtime import table
from .projection import current_nodes

TERMS = ["parser", "cache", "index", "route"]


def bm25_documents(s, d) -> DataFrame:
    hits = se.bm25(table(s, d, "documents"), "doc_id", "text", TERMS)
    return hits.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(200)


def bm25_top3_by_source(s, d):
    hits = se.bm25(table(s, d, "documents"), "doc_id", "text", TERMS).withColumn("score", F.round("score", 6))
    best = summed_best(hits.join(table(s, d, "documents").filter("source is not null").select("doc_id", "source"), "doc_id"), "source", "score", "doc_id")
    return best.withColumn("score", F.round("score", 5))


def token_statistics(s, d):
    t = se.token_table(table(s, d, "documents"), "doc_id", "text")
    return t.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def _anchor(s, d) -> list[float]:
    return table(s, d, "embeddings").orderBy("vec_id").limit(1).first().embedding


def cosine_topk(s, d):
    near = se.cosine_topk(table(s, d, "embeddings"), "vec_id", "embedding", _anchor(s, d), 50)
    return near.select("vec_id", F.round("distance", 6).alias("distance"))


def best_chunk_per_node(s, d):
    e = table(s, d, "embeddings")
    point = F.array(*[F.lit(float(x)) for x in _anchor(s, d)])
    rows = e.select("label", "vec_id", F.round(cosine_distance(F.col("embedding"), point), 6).alias("distance"))
    return best_per_key(rows, "label", "distance", ["vec_id"])


def rrf_fusion(s, d):
    kw = se.ranked(bm25_documents(s, d).limit(20).select(F.col("doc_id").alias("key"), "score"), [F.desc("score"), F.asc("key")])
    vec = se.ranked(cosine_topk(s, d).limit(20).select(F.col("vec_id").alias("key"), "distance"), [F.asc("distance"), F.asc("key")])
    fused = se.rrf(kw, vec, "key", 30)
    return fused.withColumn("score", F.round("score", 6))


def hybrid_keyword_only(s, d):
    """A fusion whose vector lane fails is the keyword lane."""

    def broken():
        raise RuntimeError("no vector index")

    kw = lambda: se.ranked(bm25_documents(s, d).select(F.col("doc_id").alias("key"), "score"), [F.desc("score"), F.asc("key")])
    return se.hybrid(kw, broken, "key", 25)[0].select("key", "rank", "in_keyword", "in_semantic")


def grep_lines(s, d):
    return tx.grep(table(s, d, "documents"), "doc_id", "text", r"\breturn\s+[a-z]+", limit=200)


def char_chunks(s, d):
    c = tx.char_chunks(table(s, d, "documents"), "doc_id", "text")
    return c.select("doc_id", "chunk_index", "start_offset", "end_offset", F.md5("text").alias("digest"))


def chunk_tails(s, d):
    """The last 20 characters of the piece before each piece."""
    from pyspark.sql import Window

    c = tx.char_chunks(table(s, d, "documents"), "doc_id", "text")
    tail = F.lag(F.expr("right(text, 20)")).over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    return c.select("doc_id", "chunk_index", F.md5(tail).alias("previous_tail"))


def chunk_lines(s, d):
    c = tx.char_chunks(table(s, d, "documents"), "doc_id", "text")
    full = table(s, d, "documents").select("doc_id", F.col("text").alias("whole"))
    rows = c.join(full, "doc_id")
    return rows.select("doc_id", "chunk_index", tx.display_line(tx.line_of(F.col("whole"), F.col("start_offset"))).alias("line"))


def cjk_bigrams(s, d):
    return table(s, d, "documents").select("doc_id", tx.cjk_bigrams(F.col("text")).alias("text"))


def text_functions(s, d):
    t = F.col("text")
    return table(s, d, "documents").select(
        "doc_id", F.md5(tx.one_line(t)).alias("one_line"), tx.longest_identifier(t).alias("identifier"), F.length(tx.utf8_cut(t, 100)).alias("in_100_bytes"),
        tx.half_up(F.col("n_chars") / 7, 2).alias("seventh"), tx.branch_slug(F.coalesce("source", F.lit("None Here"))).alias("slug"),
    )


def folders(s, d):
    nodes, edges = folder_tree(table(s, d, "why_ignored_result").select(F.concat_ws("/", "repo", "path").alias("path")))
    up = edges.select(F.col("dst").alias("id"), F.col("src").alias("parent"))
    return nodes.join(up, "id", "left").select("id", "label", "name", "parent")


def sections(s, d):
    return markdown_sections(table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"))


def augmentation(s, d):
    """What surrounds the symbols whose name contains a word; edges are call chains within a file by order."""
    from pyspark.sql import Window

    n = current_nodes(s, d).filter("label in ('Function', 'Method')")
    w = Window.partitionBy("file_path", "repo").orderBy("start_line", "id")
    e = n.select(F.col("id").alias("src"), F.lead("id").over(w).alias("dst"), F.lit("CALLS").alias("type")).filter("dst is not null")
    return se.augment(n, e, "Cache", symbols=20)


QUERIES = {
    f.__name__: f
    for f in [
        bm25_documents, bm25_top3_by_source, token_statistics, cosine_topk, best_chunk_per_node, rrf_fusion, hybrid_keyword_only, grep_lines, char_chunks, chunk_tails, chunk_lines, cjk_bigrams,
        text_functions, folders, sections, augmentation,
    ]
}

_BM25 = """
w as (select doc_id, source, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
stats as (select count(*) as n, avg(len(w)) as avg_len from w),
hit as (select doc_id, source, len(w) as length, unnest(list_filter(w, lambda x: x in ('parser', 'cache', 'index', 'route'))) as term from w),
tf as (select doc_id, source, length, term, count(*) as tf from hit group by all),
df as (select term, count(*) as df from tf group by 1),
bm as (select doc_id, source, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_len))), 6) as score
  from tf join df using (term), stats group by 1, 2)
"""
_COS = """anchor as (select embedding as e from embeddings order by vec_id limit 1),
cos_ as (select vec_id, label, round(1 - list_dot_product(x.embedding::double[], e::double[]) / (sqrt(list_dot_product(x.embedding::double[], x.embedding::double[])) * sqrt(list_dot_product(e::double[], e::double[]))), 6) as distance
  from embeddings x, anchor)"""
_CHUNKS = """chunks as (
  select doc_id, unnest(generate_series(0, case when length(text) <= 1200 then 0 else ceil((length(text) - 1200) / 1080)::int end))::int as chunk_index, text from documents where text is not null),
cut as (select doc_id, chunk_index, chunk_index * 1080 as start_offset, least(chunk_index * 1080 + 1200, length(text)) as end_offset, text from chunks)"""
_RRF = f"""with {_BM25}, {_COS},
  k as (select doc_id as key, 1 / (60 + row_number() over (order by score desc, doc_id)) as s from (select * from bm order by score desc, doc_id limit 20)),
  v as (select vec_id as key, 1 / (60 + row_number() over (order by distance, vec_id)) as s from (select * from cos_ order by distance, vec_id limit 20)),
  f as (select coalesce(k.key, v.key) as key, coalesce(k.s, 0) + coalesce(v.s, 0) as score, k.key is not null as in_keyword, v.key is not null as in_semantic from k full join v on k.key = v.key)"""

ORACLE = {
    "text_functions": r"""with d as (select *, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*') as w from documents)
        select doc_id, md5(regexp_replace(text, '[\r\n\t]', ' ', 'g')) as one_line, list_filter(w, lambda x: length(x) = list_max(list_transform(w, lambda y: length(y))) and length(x) >= 3)[1] as identifier,
          case when text is not null then len(list_filter(range(1, least(length(text), 100) + 1), lambda i: strlen(substring(text, 1, i)) <= 100))::int end as in_100_bytes, floor(n_chars::double / 7 * 100.0::double + 0.5) / 100.0::double as seventh,
          regexp_replace(regexp_replace(lower(coalesce(source, 'None Here')), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from d""",
    "cjk_bigrams": r"""with d as (select doc_id, text, regexp_extract_all(text, '(?s).') as c from documents), k as (select *, list_transform(c, lambda x: x between chr(19968) and chr(40959)) as k, list_transform(c, lambda x: not regexp_matches(x, '[\s\x{0B}\p{Z}\x{FEFF}\x{4E00}-\x{9FFF}]')) as o from d)
        select doc_id, case when text is not null then array_to_string(list_transform(c, lambda x, i:
          case when (coalesce(o[i - 1], false) and k[i] and coalesce(k[i + 1], false)) or (i > 2 and coalesce(k[i - 2], false) and coalesce(k[i - 1], false) and o[i]) then ' ' else '' end
          || case when i > 1 and coalesce(k[i - 1], false) and k[i] and coalesce(k[i + 1], false) then x || ' ' || x else x end), '') end as text from k""",
    "bm25_documents": f"with {_BM25} select doc_id, score from bm order by score desc, doc_id limit 200",
    "bm25_top3_by_source": f"""with {_BM25}, r as (select *, row_number() over (partition by source order by score desc, doc_id) as rank from bm where source is not null)
        select source, round(sum(score), 5) as score, list(doc_id order by rank) as ids from r where rank <= 3 group by 1""",
    "token_statistics": """with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from documents),
        c as (select doc_id, term, count(*) as tf from t group by 1, 2) select term, count(*) as df, sum(tf)::bigint as tf from c group by 1""",
    "cosine_topk": f"with {_COS} select vec_id, distance from cos_ order by distance, vec_id limit 50",
    "best_chunk_per_node": f"with {_COS} select label, vec_id, distance from cos_ qualify row_number() over (partition by label order by distance, vec_id) = 1",
    "rrf_fusion": _RRF + " select key, round(score, 6) as score, in_keyword, in_semantic, row_number() over (order by score desc, key) as rank from f qualify rank <= 30",
    "hybrid_keyword_only": f"with {_BM25} select doc_id as key, row_number() over (order by score desc, doc_id) as rank, true as in_keyword, false as in_semantic from bm qualify rank <= 25",
    "grep_lines": """with l as (select doc_id, unnest(str_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) as t, generate_subscripts(str_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) as line from documents)
        select doc_id, line, t[1:200] as text from l where regexp_matches(t, '\\breturn\\s+[a-z]+') order by doc_id, line limit 200""",
    "char_chunks": f"with {_CHUNKS} select doc_id, chunk_index, start_offset, end_offset, md5(substr(text, start_offset + 1, end_offset - start_offset)) as digest from cut",
    "chunk_tails": f"""with {_CHUNKS}, c as (select doc_id, chunk_index, substr(text, start_offset + 1, end_offset - start_offset) as t from cut)
        select doc_id, chunk_index, md5(lag(substr(t, greatest(length(t) - 19, 1), 20)) over (partition by doc_id order by chunk_index)) as previous_tail from c""",
    "chunk_lines": f"with {_CHUNKS} select doc_id, chunk_index, (length(substr(text, 1, start_offset)) - length(replace(substr(text, 1, start_offset), chr(10), '')) + 1)::int as line from cut",
    "folders": """with p as (select distinct str_split(concat_ws('/', repo, path), '/') as p from why_ignored_result),
        r as (select p, unnest(generate_series(1, len(p))) as k from p)
        select distinct case when k = len(p) then 'File' else 'Folder' end || ':' || array_to_string(p[1:k], '/') as id, case when k = len(p) then 'File' else 'Folder' end as label, p[k] as name,
          case when k > 1 then 'Folder:' || array_to_string(p[1:k - 1], '/') end as parent from r""",
    "sections": """with l as (select doc_id::varchar as file, regexp_split_to_array(text, '\\r\\n|\\r|\\n') as ls from documents where text is not null),
        u as (select file, len(ls) as n, unnest(ls) as t, generate_subscripts(ls, 1) as line from l),
        h as (select file, n, line, length(regexp_extract(t, '^(#{1,6})\\s+.+$', 1)) as level, trim(regexp_extract(t, '^#{1,6}\\s+(.+)$', 1)) as heading from u where regexp_matches(t, '^#{1,6}\\s+.+$'))
        select file, level::int as level, heading, line, coalesce((select min(x.line) - 1 from h x where x.file = h.file and x.line > h.line and x.level <= h.level), n) as end_line,
          (select max(x.line) from h x where x.file = h.file and x.line < h.line and x.level < h.level) as parent_line from h""",
}
