"""The queries of the operators, on whole tables, and the SQL that some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import table
from strandline.session import tune

BATCH = "1000"  # rows of a batch sent to Python: texts are long

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings that the operators count on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return tune(spark)


def query(name: str, oracle: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(prepared(spark), folder)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


@query("op1_mixing", """
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
         md5('mix:' || coalesce(cast(doc_id as varchar), '')) as h
  from documents),
units as (select source, h, doc_id, size, sum(size) as words from sized group by source, h, doc_id, size),
summed as (select source, cast(sum(words) as bigint) as source_size from units group by source),
src as (select *, row_number() over (order by source nulls last) as position from summed),
weighed as (select *, case (position - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 3 * source_size as cap from src),
filling as (
  select *, cap::double / weight as full_at, sum(source_size) over () as budget,
         (sum(source_size) over ()) - (sum(cap) over w) + cap as rest, (sum(weight) over ()) - (sum(weight) over w) + weight as sharing
  from weighed window w as (order by cap::double / weight, position rows unbounded preceding)),
lev as (select full_at, position, rest, sharing from filling where rest * weight <= cap * sharing order by full_at, position limit 1),
targets as (
  select f.source, f.position, f.weight, f.source_size, f.budget,
         case when (f.full_at, f.position) < (l.full_at, l.position) then f.cap::double else l.rest::double * f.weight / l.sharing end as target
  from filling f, lev l),
queued as (select u.*, t.position, t.weight, t.source_size, t.budget,
         sum(words) over (partition by t.position order by h, doc_id, size rows unbounded preceding) as upto
  from units u join targets t on u.source is not distinct from t.source),
entries as (select *, (upto + r * source_size)::double / weight as finish from queued, range(3) x(r)),
run as (select *, sum(words) over (order by finish, position, r, h, doc_id, size rows unbounded preceding) as total from entries),
copies as (select position, h, doc_id, size, sum(case when total <= budget then 1 else 0 end) as copies from run group by position, h, doc_id, size)
select s.doc_id, cast(s.size as bigint) as size, t.source_size, t.target, cast(c.copies * s.size as bigint) as taken
from sized s join targets t on s.source is not distinct from t.source
join copies c on c.position = t.position and c.h = s.h and c.doc_id is not distinct from s.doc_id and c.size = s.size
""")
def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from strandline.llm.mixing import mix_sources

    return mix_sources(table(spark, folder, "documents")).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_copies") * F.col("mix_size")).alias("taken"),
    )


@query("op9_simhash")
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from strandline.llm.simhash import simhash_groups

    return simhash_groups(table(spark, folder, "documents").select("doc_id", "text"))


@query("op4_lattice")
def op4_lattice(spark: SparkSession, folder: str) -> DataFrame:
    from strandline.llm.lattice import embedding_groups

    return embedding_groups(table(spark, folder, "embeddings").select("vec_id", "embedding"))


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from public_tokenizers import path

    from strandline.llm.token_counts import token_counts

    return token_counts(table(spark, folder, "documents").select("doc_id", "text"), path("byte_bpe_50k.json"))


@query("op6_token_files")
def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    from public_tokenizers import path

    from strandline.llm.token_files import token_files

    return token_files(table(spark, folder, "documents"), path("word_bpe_49k.json"))


@query("op7_warc", """
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
f as (select h, min(page_id) as first from p group by h),
d as (
  select p.page_id, strlen(p.html) as n, p.h, f.first, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         cast(floor(cast(concat('0x', substr(p.h, 5 * cast(floor(k / 4) as int) + 1, 5)) as bigint) / (32 ** (3 - k % 4))) as bigint) % 32 + 1, 1), '' order by k) as digest
  from p join f on p.h = f.h cross join range(32) r(k) group by p.page_id, p.html, p.h, f.first)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from d
""")
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    from strandline.llm.warc import archived_pages

    return archived_pages(table(spark, folder, "pages"))


@query("op2_html_text")
def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    from strandline.llm.html_text import extract

    return extract(table(spark, folder, "pages"))


@query("op8_quality")
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    from strandline.llm.quality import learn, remainder, score

    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, folder, "labels"))
    return score(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op3_langid")
def op3_langid(spark: SparkSession, folder: str) -> DataFrame:
    from strandline.llm.langid import learn, predict
    from strandline.llm.quality import remainder

    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return predict(docs.select("doc_id", "text"), learn(docs)).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from strandline.llm.decontam import contaminated

    return contaminated(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))


# SQL: crc32 of a text column by its table, in place of the function that it lacks.
CRC = """
bits(i, k, c) as (select i, 0, i from range(256) t(i) union all
  select i, k + 1, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end from bits where k < 8),
crc_table as (select list(c order by i) as t from bits where k = 8)"""


def crc(text: str) -> str:
    """SQL: crc32 of ASCII ``text``, beside the table ``crc_table``."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)"
    return f"xor(list_reduce({codes}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::bigint), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar) || ':' || {value}::varchar, '-')"


@query("op12_manifest", f"""
with recursive {CRC},
d as (select doc_id, source, {crc("doc_id::varchar")} % 5 = 0 as tampered,
         sha256({"||".join(map(_field, ["doc_id", "source", "lang", "n_chars", "text"]))}) as leaf,
         sha256({"||".join(map(_field, ["doc_id", "source", "lang", "n_chars", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"]))}) as other
  from documents, crc_table),
ranked as (select *, dense_rank() over (order by source nulls first) - 1 as tree,
         row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by source) as n from d),
low(tree, level, idx, n, digest) as (
  select tree, 0, idx, n, leaf from ranked
  union all
  select tree, level + 1, idx // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' order by idx)) from low where n > 1 group by tree, level, idx // 16),
top(level, idx, n, digest) as (
  select 0, tree, count(*) over (), digest from low where n = 1
  union all
  select level + 1, idx // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' order by idx)) from top where n > 1 group by level, idx // 16),
nodes as (select tree, level, idx, n, digest from low union all select -1, level, idx, n, digest from top),
around as (select a.tree, a.level, a.idx, a.n,
         coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx < a.idx), '') as pre,
         coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx > a.idx), '') as post
  from nodes a join nodes b on a.tree = b.tree and a.level = b.level and a.idx // 16 = b.idx // 16 where a.n > 1 group by all),
path(doc, leaf_idx, tree, level, idx, proof, folded) as (
  select tree, idx, tree, 0, idx, '', case when tampered then other else leaf end from ranked
  union all
  select p.doc, p.leaf_idx, case when a.tree is null then -1 else p.tree end, case when a.tree is null then 0 else p.level + 1 end,
         case when a.tree is null then p.doc else p.idx // 16 end, p.proof || coalesce(a.pre || a.post, ''),
         case when a.tree is null then p.folded else sha256(a.pre || p.folded || a.post) end
  from path p left join around a on a.tree = p.tree and a.level = p.level and a.idx = p.idx
  where a.tree is not null or p.tree >= 0),
ends as (select doc, leaf_idx, proof, folded from path p where tree = -1 and level = (select max(level) from top))
select r.doc_id, r.leaf, s.digest as subroot, t.digest as root, sha256(e.proof) as proof_sha256, e.folded as folded_root, e.folded = t.digest as verified
from ranked r join low s on s.tree = r.tree and s.n = 1 join top t on t.n = 1 join ends e on e.doc = r.tree and e.leaf_idx = r.idx
""")
def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    from strandline.llm.manifest import audited

    out = audited(table(spark, folder, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op13_conversations", f"""
with recursive {CRC},
hit as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         {crc("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as k from conversations, crc_table),
rows_ as (select conv_id, turn, case k when 4 then 'user' else role end as role,
         case k when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from hit, unnest(case k when 3 then [0, 1] else [0] end) u(c) where k <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos, left(role, 1) as ini,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from rows_),
judged as (select *, case when bare = '' then 1 when row_number() over (partition by conv_id, role, text order by pos) > 1 then 2
         when right(bare, 1) not in ('.', '!', '?') then 3 else 0 end as fault,
         lag(ini) over (partition by conv_id order by pos) || ini as pair from placed),
keeps(ini, s, t) as (values ('s', '0', 's'), ('u', '0', 'u'), ('u', 's', 'u'), ('a', 'u', 'a'), ('u', 'a', 'u')),
turns(s, t, role) as (values ('0', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')),
fills(s, t, k, more, added) as (
  select distinct s, s, 0, '', null from turns union all select s, t, 1, 'I', role || ':' from turns
  union all select a.s, b.t, 2, 'II', a.role || ':' || chr(10) || b.role || ':' from turns a join turns b on a.t = b.s),
ways(conv_id, pos, s, best) as (
  select c.conv_id, 0::bigint, f.t, struct_pack(cost := 5 * f.k::bigint, audit := f.more, body := f.added)
  from (select distinct conv_id from rows_) c, fills f where f.s = '0'
  union all
  select conv_id, pos, t, min(struct_pack(cost := cost, audit := audit, body := body)) from (
    select w.conv_id, w.pos + 1 as pos, f.t, w.best.cost + e.cost + case when r.fault = 3 and e.edit <> 'D' then 5 else 0 end + 5 * f.k as cost,
           w.best.audit || e.edit || f.more as audit,
           nullif(concat_ws(chr(10), w.best.body, case when e.edit <> 'D' then coalesce(e.role, r.role) || ':' || r.text end, f.added), '') as body
    from ways w join judged r on r.conv_id is not distinct from w.conv_id and r.pos = w.pos + 1
    join (select s, t, 1 as cost, 'R' as edit, role, null as ini from turns union all select s, t, 0, 'K', null, ini from keeps
          union all select distinct s, s, 2, 'D', null, null from turns) e
      on e.s = w.s and (e.edit = 'D' or r.fault in (0, 3)) and (e.ini is null or e.ini = r.ini)
    join fills f on f.s = e.t) x
  group by conv_id, pos, t),
facts as (select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) as n, count(*) filter (fault = 1) as blank,
         count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
         count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal from judged group by conv_id),
ends as (select f.conv_id, min(w.best) as best from ways w join facts f on f.conv_id is not distinct from w.conv_id and w.pos = f.n
         where w.s in ('0', 'a') group by f.conv_id)
select c.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank, cast(coalesce(duplicate, 0) as bigint) as duplicate,
       cast(coalesce(truncated, 0) as bigint) as truncated, cast(coalesce(illegal, 0) as bigint) as illegal, cast(coalesce(e.best.cost, 0) as bigint) as cost,
       coalesce(e.best.audit, '') as audit, sha256(coalesce(e.best.body, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join facts f on f.conv_id is not distinct from c.conv_id
left join ends e on e.conv_id is not distinct from c.conv_id
""")
def op13_conversations(spark: SparkSession, folder: str) -> DataFrame:
    from strandline.llm.conversations import repaired_damage

    return repaired_damage(table(spark, folder, "conversations"))


@query("op11_licenses")
def op11_licenses(spark: SparkSession, folder: str) -> DataFrame:
    from strandline.llm.licenses import scan

    return scan(table(spark, folder, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )
