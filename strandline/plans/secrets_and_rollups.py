"""Redaction queries and repository roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.redaction import BUILTIN, RedactionRules, SecretPattern, blank_environment, with_redaction
from strandline.operators import rollups as P
from strandline.operators import secrets as K
from strandline.plans.registry import query
from strandline.sources.derived import duckdb_query


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chain(source: str, custom=(), secrets=()) -> tuple[str, ...]:
    """DuckDB CTEs s0, s1, … over ``source`` (…, t); the last is ``redacted`` with counts n0, n1, …"""
    ctes = [f"s0 as ({source})"]
    i = 0
    for secret in secrets:
        ctes.append(f"s{i + 1} as (select * replace (replace(t, {_lit(secret)}, '[REDACTED]') as t), "
                    f"cast(contains(t, {_lit(secret)}) as int) as n{i} from s{i})")
        i += 1
    for p in [*BUILTIN, *custom]:
        regex = _lit(("(?i)" if p.ignore_case else "") + p.regex)
        replacement = _lit(p.replacement.replace("$1", r"\1").replace("$2", r"\2"))
        ctes.append(f"s{i + 1} as (select * replace (regexp_replace(t, {regex}, {replacement}, 'g') as t), "
                    f"len(regexp_extract_all(t, {regex})) as n{i} from s{i})")
        i += 1
    ctes.append(f"redacted as (select * from s{i})")
    return tuple(ctes)


def counts_text(custom=(), secrets=()) -> str:
    """DuckDB text ``id=count,…`` of the stages that hit."""
    ids = ["explicit_secret"] * len(secrets) + [p.id for p in [*BUILTIN, *custom]]
    parts = ", ".join(f"case when n{i} > 0 then '{p}=' || n{i} end" for i, p in enumerate(ids))
    return f"concat_ws(',', {parts})"


_COUNTS = "array_join(transform(detections, d -> concat(d.pattern_id, '=', d.count)), ',')"

CUSTOM = [SecretPattern("planted", r"token = \"[0-9a-f]+\""), SecretPattern("broken", r"(unclosed")]
VALID = CUSTOM[:1]


@query("redacted_commands", "K1 K2 K5 K6", duckdb_query("select id, t as command from redacted", *chain("select id, command as t from jobs")))
def _(w):
    return K.redact_commands(w.jobs).select("id", "command")


@query("redacted_git_urls", "K7", duckdb_query("select id, t as git_repo from redacted",
    *chain("select id, case id % 3 when 0 then git_repo else 'https://user' || id || ':tok' || id || '@host/p' || session_id || '.git' end as t from jobs")))
def _(w):
    urls = w.jobs.selectExpr("id", "case id % 3 when 0 then git_repo else concat('https://user', id, ':tok', id, '@host/p', session_id, '.git') end as git_repo")
    return K.redact_git_urls(urls)


@query("redacted_documents", "K2 K5", duckdb_query(f"select doc_id, md5(t) as digest, length(t) as chars, {counts_text()} as detections from redacted",
    *chain("select doc_id, text as t from documents")))
def _(w):
    found = with_redaction(w.base("documents").select("doc_id", "text"), "text")
    return found.select("doc_id", F.md5("filtered").alias("digest"), F.length("filtered").cast("bigint").alias("chars"), F.expr(_COUNTS).alias("detections"))


SECRETS = ["example", "token = "]


@query("redacted_conversations", "K1 K3", duckdb_query(
    f"select conv_id, turn, md5(t) as digest, {counts_text(VALID, SECRETS[:1])} as detections from redacted",
    *chain("select conv_id, turn, text as t from conversations", VALID, SECRETS[:1])))
def _(w):
    rules = RedactionRules(secrets=SECRETS[:1], custom=CUSTOM)
    found = with_redaction(w.base("conversations").select("conv_id", "turn", "text"), "text", rules)
    return found.select("conv_id", "turn", F.md5("filtered").alias("digest"), F.expr(_COUNTS).alias("detections"))


@query("custom_patterns", "K3", duckdb_query(
    f"select doc_id, md5(t) as digest, {counts_text(VALID)} as detections from redacted",
    *chain("select doc_id, text as t from documents", VALID)))
def _(w):
    found = with_redaction(w.base("documents").select("doc_id", "text"), "text", RedactionRules(custom=CUSTOM))
    return found.select("doc_id", F.md5("filtered").alias("digest"), F.expr(_COUNTS).alias("detections"))


# A match holding the allowed text stays: mask it first in SQL, so that nothing matches it.
@query("allow_listed_commands", "K4", duckdb_query("""
select id, case when id % 50 = 13 then replace(command, 'MY_TOKEN=abc123', 'MY_TOKEN=abc123') else t end as command,
       case when id % 50 = 13 then 0 else n16 end as assignments
from (select r.*, j.command from redacted r join jobs j using (id))""", *chain("select id, command as t from jobs")))
def _(w):
    found = with_redaction(w.jobs.select("id", "command"), "command", RedactionRules(allow=[r"^MY_TOKEN=abc\d+$"]), filtered="clean")
    hits = F.expr("coalesce(try_element_at(filter(detections, d -> d.pattern_id = 'env_var_assignment'), 1).count, 0)")
    return found.select("id", F.col("clean").alias("command"), hits.cast("bigint").alias("assignments"))


@query("redacted_metadata", "K8", duckdb_query("""
select id, case when id % 3 = 0 then '{"n":' || id || '}' else '{"runtime": {"command": "' || t || '", "env_vars": {"GITHUB_TOKEN": "[REDACTED]", "HOME": "' || git_branch
  || '"}}, "n": ' || id || '}' end as metadata from redacted""", *chain("select id, git_branch, command as t from jobs")))
def _(w):
    # A third of the rows holds nothing that could match and stays as it is.
    jobs = w.jobs.selectExpr("id", """if(id % 3 = 0, to_json(named_struct('n', id)),
      to_json(named_struct('runtime', named_struct('command', command, 'env_vars', map('GITHUB_TOKEN', 'x', 'HOME', git_branch)), 'n', id))) as metadata""")
    return K.redact_metadata(jobs)


@query("redacted_packages", "K8", duckdb_query("select id, t as origin from redacted",
    *chain("select id, 'index=https://u' || id || ':pw@pypi/' || git_branch as t from jobs")))
def _(w):
    # The typed part of metadata: string values of a map, filtered inside the JVM.
    from strandline.functions.redaction import redact
    jobs = w.jobs.selectExpr("id", "map('origin', concat('index=https://u', id, ':pw@pypi/', git_branch)) as m")
    return jobs.select("id", F.transform_values("m", lambda k, v: redact(v))["origin"].alias("origin"))


@query("blanked_environment", "K9", duckdb_query("""
select id, '[REDACTED]' as token, git_branch as home from jobs"""))
def _(w):
    env = w.jobs.selectExpr("id", "map('GITHUB_TOKEN', command, 'HOME', git_branch) as env")
    clean = env.withColumn("env", blank_environment(F.col("env")))
    return clean.select("id", F.col("env")["GITHUB_TOKEN"].alias("token"), F.col("env")["HOME"].alias("home"))


@query("redacted_telemetry", "K10", duckdb_query("""
select r.id, case when r.id % 2 = 1 then r.t
  when not contains(lower(j.command), 'key') and not contains(lower(j.command), 'token') and not contains(j.command, '://') then '{"wandb":"' || r.t || '"}' else '{"wandb": "' || r.t || '"}' end as telemetry
from redacted r join jobs j on j.id = r.id""", *chain("select id, command || ' 8h' as t from jobs")))
def _(w):
    # JSON for every other job, text for the rest.
    jobs = w.jobs.selectExpr("id", "case when id % 2 = 0 then to_json(named_struct('wandb', command || ' 8h')) else command || ' 8h' end as telemetry")
    return K.redact_telemetry(jobs)


_IDS = ", ".join(f"('{p.id}', n{i})" for i, p in enumerate(BUILTIN))


_IDS_PLANTED = _IDS + f", ('planted', n{len(BUILTIN)})"


@query("detected_secrets", "K11", duckdb_query(f"""
select doc_id, v.pattern_id, v.n as count from redacted, lateral (values {_IDS_PLANTED}) v(pattern_id, n) where v.n > 0""",
    *chain("select doc_id, text as t from documents", VALID)))
def _(w):
    return K.detect(w.base("documents"), ["doc_id"], "text", RedactionRules(custom=CUSTOM))


SCAN = chain("""select session_id, 'git_url' as field, git_repo as t from jobs union all select session_id, 'command', command from jobs
  union all select session_id, 'metadata', metadata from jobs""")


@query("scanned_lineage", "K12", duckdb_query(f"""
select session_id, field, v.pattern_id, cast(sum(v.n) as bigint) as detections
from redacted, lateral (values {_IDS}) v(pattern_id, n) where v.n > 0 group by all""", *SCAN))
def _(w):
    return K.scan_lineage(w.jobs)


@query("secret_kinds", "E7", duckdb_query(f"""
select distinct session_id, v.pattern_id from redacted, lateral (values {_IDS}) v(pattern_id, n) where v.n > 0""", *SCAN))
def _(w):
    return K.secret_kinds(K.scan_lineage(w.jobs), "session_id")


@query("redacted_lineage", "K13", duckdb_query("select r.id, r.t as command, j.git_repo, j.metadata from redacted r join jobs j using (id)",
    *chain("select id, command as t from jobs")))
def _(w):
    # The package versions in the metadata are no secrets: it must come out as it went in.
    return K.redact_lineage(w.jobs).select("id", "command", "git_repo", "metadata")


URLS = """urls as (
  select id, session_id, case id % 4 when 0 then git_repo when 1 then 'ssh://git@github.com/org/p' || (session_id % 25)
    when 2 then 'https://github.com/org/p' || (session_id % 25) || '.git' else 'http://github.com/org/p' || (session_id % 25) end as url from jobs)"""


def _urls(w):
    return w.jobs.selectExpr("id", "session_id", """case id % 4 when 0 then git_repo when 1 then concat('ssh://git@github.com/org/p', session_id % 25)
    when 2 then concat('https://github.com/org/p', session_id % 25, '.git') else concat('http://github.com/org/p', session_id % 25) end as git_repo""")


@query("repository_activity", "P1", duckdb_query("""
select 'github.com/org/p' || (session_id % 25) as repository, count(distinct u.id) as jobs, count(distinct session_id) as sessions,
       count(distinct url) as spellings, count(distinct o.artifact_id) as artifacts
from urls u left join job_outputs o on o.job_id = u.id group by 1""", URLS))
def _(w):
    return P.repository_activity(_urls(w), w.outputs)


@query("repository_spellings", "P1", duckdb_query(
    "select distinct 'github.com/org/p' || (session_id % 25) as repository, url from urls", URLS))
def _(w):
    return P.repository_spellings(_urls(w))


@query("clone_urls", "P2", duckdb_query(r"""
select distinct url, regexp_matches(url, '^(?:ssh://)?git@[^:/]+[:/]') as is_ssh,
  case when starts_with(url, 'git@') then 'https://' || replace(substr(url, 5), ':', '/')
       when starts_with(url, 'ssh://git@') then 'https://' || substr(url, 11) end as https_url from urls""", URLS))
def _(w):
    return P.clone_urls(_urls(w))


@query("matching_checkouts", "H10", duckdb_query("""
select u.id as plan_id, s.checkout, s.checkouts from urls u join (
  select id % 25 as repo, min('c' || id) as checkout, count(*) as checkouts from sessions group by id % 25) s on s.repo = u.session_id % 25""", URLS))
def _(w):
    plans = _urls(w).withColumnRenamed("id", "plan_id")
    checkouts = w.sessions.selectExpr("concat('c', id) as checkout", "git_repo as remote_url")
    return P.matching_checkouts(plans, checkouts)


_PAGE = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)/?([^?#]*)', {})"


@query("page_storage_usage", "P3", f"""
select scheme, bucket, folder, count(*) as objects, cast(sum(size) as bigint) as bytes, grouping(scheme, bucket, folder) as level
from (select lower({_PAGE.format(1)}) as scheme, {_PAGE.format(2)} as bucket, length(html) as size,
        regexp_replace({_PAGE.format(3)}, case when ends_with({_PAGE.format(3)}, '/') and not contains(url, '?') and not contains(url, '#') then '/+$' else '/?[^/]*$' end, '') as folder from pages)
group by rollup (scheme, bucket, folder)""")
def _(w):
    return P.storage_usage(w.base("pages").select(F.col("url").alias("source_url"), F.length("html").cast("bigint").alias("size")))


@query("artifact_storage_usage", "P3", duckdb_query("""
select scheme, bucket, folder, count(*) as objects, cast(sum(size) as bigint) as bytes, grouping(scheme, bucket, folder) as level
from (select case when size % 3 = 0 then 'gs' else 's3' end as scheme, 'b' || (size % 5) as bucket,
        regexp_replace(first_seen_path, '/[^/]*$', '') as folder, size from artifacts)
group by rollup (scheme, bucket, folder)"""))
def _(w):
    return P.storage_usage(w.artifacts.selectExpr("concat(if(size % 3 = 0, 'GS', 's3'), '://b', size % 5, '/', first_seen_path) as source_url", "size"))
