"""Secret patterns and the column expressions that find and blank them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"


@dataclass(frozen=True)
class SecretPattern:
    id: str
    regex: str
    replacement: str = REDACTED
    ignore_case: bool = False
    # Lower-case texts one of which every match holds; empty for patterns not known to us.
    needs: tuple[str, ...] = ()

    @property
    def jvm(self) -> str:
        """The pattern with Unicode classes, as Python text patterns have them, and Java's named groups."""
        regex = self.regex
        for i, name in enumerate(re.findall(r"\(\?P<(\w+)>", regex)):
            regex = regex.replace(f"(?P<{name}>", f"(?<named{i}>").replace(f"(?P={name})", rf"\k<named{i}>")
        return ("(?iuU)" if self.ignore_case else "(?U)") + regex

    @property
    def python(self) -> re.Pattern:
        return re.compile(self.regex, re.IGNORECASE if self.ignore_case else 0)

    @property
    def python_replacement(self) -> str:
        return re.sub(r"\$(\d)", r"\\\1", self.replacement)


# Patterns, their order and their replacements decide the redacted text.
BUILTIN = [
    SecretPattern("aws_access_key", r"(AKIA[A-Z0-9]{16})", "[AWS_KEY_REDACTED]", needs=("akia",)),
    SecretPattern("aws_secret_key", r"(aws_secret_access_key|aws_secret)[=:\s]+['\"]?([A-Za-z0-9/+=]{40})['\"]?", "$1=[REDACTED]", True, needs=("aws_secret",)),
    SecretPattern("github_token", r"(ghp_[A-Za-z0-9]{36,})", "[GITHUB_TOKEN_REDACTED]", needs=("ghp_",)),
    SecretPattern("github_pat", r"(github_pat_[a-zA-Z0-9]{22}_[a-zA-Z0-9]{59})", "[GITHUB_PAT_REDACTED]", needs=("github_pat_",)),
    SecretPattern("openai_key", r"(sk-[a-zA-Z0-9]{20,})", "[OPENAI_KEY_REDACTED]", needs=("sk-",)),
    SecretPattern("anthropic_key", r"(sk-ant-[a-zA-Z0-9\-]+)", "[ANTHROPIC_KEY_REDACTED]", needs=("sk-ant-",)),
    SecretPattern("huggingface_token", r"(hf_[a-zA-Z0-9]{34})", "[HF_TOKEN_REDACTED]", needs=("hf_",)),
    SecretPattern("generic_api_key_arg", r"(--?(?:api[_-]?key|apikey))[=\s]+['\"]?([^\s'\"]{16,})['\"]?", "$1=[REDACTED]", True, needs=("key",)),
    SecretPattern("generic_token_arg", r"(--?(?:token|auth[_-]?token))[=\s]+['\"]?([^\s'\"]{16,})['\"]?", "$1=[REDACTED]", True, needs=("token",)),
    SecretPattern("generic_password_arg", r"(--?(?:password|passwd|pwd))[=\s]+['\"]?([^\s'\"]+)['\"]?", "$1=[REDACTED]", True, needs=("passw", "pwd")),
    SecretPattern("generic_secret_arg", r"(--?(?:secret|secret[_-]?key))[=\s]+['\"]?([^\s'\"]+)['\"]?", "$1=[REDACTED]", True, needs=("secret",)),
    SecretPattern("bearer_token", r"(bearer)\s+([a-zA-Z0-9\-._~+/]{20,}=*)", "$1 [REDACTED]", True, needs=("bearer",)),
    SecretPattern("git_url_creds", r"(https?://)([^:@]+):([^@]+)@", "$1$2:[REDACTED]@", needs=("http",)),
    SecretPattern("database_url", r"((?:postgres|mysql|mongodb|redis)://)([^:]+):([^@]+)@", "$1$2:[REDACTED]@", True, needs=("postgres:", "mysql:", "mongodb:", "redis:")),
    SecretPattern("private_key", r"(-----BEGIN\s+(?:RSA\s+|EC\s+|DSA\s+|OPENSSH\s+)?PRIVATE\s+KEY-----)", "[PRIVATE_KEY_REDACTED]", needs=("-----begin",)),
    SecretPattern("slack_webhook", r"(hooks\.slack\.com/services/)([A-Z0-9/]+)", "$1[REDACTED]", True, needs=("hooks.slack.com",)),
    SecretPattern("env_var_assignment", r"([A-Z_]*(?:KEY|TOKEN|SECRET|PASSWORD|PASSWD|PWD|CREDENTIAL|AUTH)[A-Z_]*)=([^\s]+)", "$1=[REDACTED]", True, needs=("key", "token", "secret", "passw", "pwd", "credential", "auth")),
]

# Environment variables blanked by default.
ENV_NAMES = [
    "WANDB_API_KEY",
    "OPENAI_API_KEY",
    "ANTHROPIC_API_KEY",
    "GITHUB_TOKEN",
    "DATABASE_URL",
    "AWS_SECRET_ACCESS_KEY",
]


def _folded(text: Column) -> Column:
    """Text in one case, wide enough for every letter a case-insensitive pattern takes as equal."""
    return F.lower(F.upper(text))


def _may_match(folded: Column, pattern: SecretPattern) -> Column:
    hit = F.lit(False)
    for part in pattern.needs:
        hit = hit | folded.contains(part)
    return hit


def _may_match_any(folded: Column) -> Column:
    parts = dict.fromkeys(part for pattern in BUILTIN for part in pattern.needs)
    hit = F.lit(False)
    for part in parts:
        hit = hit | folded.contains(part)
    return hit


@dataclass(frozen=True)
class RedactionRules:
    """Literal secrets, then the built-in patterns, then custom ones; ``allow`` exempts matches."""

    secrets: Sequence[str] = ()
    custom: Sequence[SecretPattern] = ()
    allow: Sequence[str] = ()
    env_names: Sequence[str] = field(default_factory=lambda: list(ENV_NAMES))

    def usable_custom(self) -> list[SecretPattern]:
        """Custom patterns that compile for Python and for Java, which runs them; others are skipped."""
        context = SparkContext._active_spark_context
        usable = []
        for pattern in self.custom:
            try:
                pattern.python
                if context is not None:
                    context._jvm.java.util.regex.Pattern.compile(pattern.jvm)
            except (re.error, Py4JJavaError):
                continue
            usable.append(pattern)
        return usable

    def may_find(self, text: Column, blank_env: bool = False) -> Column:
        """Whether filtering the leaves of a JSON text can change it; backslashes may hide anything."""
        if self.custom:
            return F.lit(True)
        hit = _may_match_any(_folded(text)) | text.contains("\\")
        for needle in [*filter(None, self.secrets), *(self.env_names if blank_env else ())]:
            hit = hit | text.contains(needle)
        return hit


def redact(text: Column, rules: RedactionRules = RedactionRules()) -> Column:
    """The redacted text, without counts: one expression, usable inside ``transform``."""
    if rules.allow:
        return redaction(text, rules)["filtered"]
    for secret in rules.secrets:
        if secret:
            text = F.replace(text, F.lit(secret), F.lit(REDACTED))

    def replaced(before: Column, pattern: SecretPattern, folded: Column) -> Column:
        possible = _may_match(folded, pattern)
        return F.transform(
            F.array(before),
            lambda t: F.when(possible, F.regexp_replace(t, pattern.jvm, pattern.replacement)).otherwise(t),
        )[0]

    def builtin(s: Column) -> Column:
        chain = s["text"]
        for pattern in BUILTIN:
            chain = replaced(chain, pattern, s["folded"])
        return F.when(_may_match_any(s["folded"]), chain).otherwise(s["text"])

    text = F.transform(F.array(F.struct(text.alias("text"), _folded(text).alias("folded"))), builtin)[0]
    for pattern in rules.usable_custom():
        text = F.regexp_replace(text, pattern.jvm, pattern.replacement)
    return text


_FOUND = "array<struct<pattern_id:string,count:int>>"


def redaction(text: Column, rules: RedactionRules = RedactionRules()) -> Column:
    """struct<filtered, detections array<struct<pattern_id, count>>> of a text.

    Stages see text the earlier ones have redacted. Each is a ``transform`` over a one-element
    array, which binds the text so far to a name: the expression holds every stage once, however
    often a stage looks at its text.
    """
    allowed = [SecretPattern("allowed", a).jvm for a in rules.allow if a]
    custom = rules.usable_custom()
    if allowed and any(p.python.search("") for p in custom):
        return _python_redaction(text, rules)  # the pieces between empty matches are not told apart by ``split``

    def state(t: Column, found: Column) -> Column:
        return F.struct(t.alias("filtered"), found.cast(_FOUND).alias("detections"))

    def stage(before: Column, pattern_id: str, hit, count, replaced) -> Column:
        def step(s: Column) -> Column:
            t = s["filtered"]
            entry = F.struct(F.lit(pattern_id).alias("pattern_id"), count(t).alias("count"))
            return F.when(hit(t), state(replaced(t), F.array_append(s["detections"], entry))).otherwise(s)

        return F.transform(F.array(before), step)[0]

    def allowing_stage(before: Column, pattern_id: str, regex: str, replacement: str, possible: Column | None) -> Column:
        """The text as pieces and matches in turn; a match that is not allowed is replaced by itself."""

        def kept(match: Column) -> Column:
            return reduce(or_, [match.rlike(a) for a in allowed])

        def put_together(s: Column, matches: Column) -> Column:
            swapped = F.transform(matches, lambda m: F.when(kept(m), m).otherwise(F.regexp_replace(m, regex, replacement)))
            pieces = F.zip_with(F.split(s["filtered"], regex, -1), swapped, lambda piece, match: F.concat(piece, F.coalesce(match, F.lit(""))))
            entry = F.struct(F.lit(pattern_id).alias("pattern_id"), F.size(F.filter(matches, lambda m: ~kept(m))).alias("count"))
            found = F.when(entry["count"] > 0, F.array_append(s["detections"], entry)).otherwise(s["detections"])
            return state(F.array_join(pieces, ""), found)

        def step(s: Column) -> Column:
            t = s["filtered"]
            hit = t.rlike(regex) if possible is None else possible & t.rlike(regex)
            return F.when(hit, F.transform(F.array(F.regexp_extract_all(t, F.lit(regex), F.lit(0))), lambda m: put_together(s, m))[0]).otherwise(s)

        return F.transform(F.array(before), step)[0]

    def regex_stage(before: Column, pattern_id: str, regex: str, replacement: str, possible: Column | None = None) -> Column:
        if allowed:
            return allowing_stage(before, pattern_id, regex, replacement, possible)
        return stage(
            before, pattern_id, lambda t: t.rlike(regex) if possible is None else possible & t.rlike(regex), lambda t: F.regexp_count(t, F.lit(regex)),
            lambda t: F.regexp_replace(t, regex, replacement),
        )

    def literal_stage(before: Column, secret: str) -> Column:
        return stage(
            before, "explicit_secret", lambda t: t.contains(secret), lambda t: F.lit(1),
            lambda t: F.replace(t, F.lit(secret), F.lit(REDACTED)),
        )

    current = state(text, F.array())
    for secret in rules.secrets:
        if secret:
            current = literal_stage(current, secret)

    # What a stage needs is looked for in the text before any pattern ran: no replacement brings
    # a later match about.
    def builtin(s: Column) -> Column:
        chain = s["state"]
        for pattern in BUILTIN:
            chain = regex_stage(chain, pattern.id, pattern.jvm, pattern.replacement, _may_match(s["folded"], pattern))
        return F.when(_may_match_any(s["folded"]), chain).otherwise(s["state"])

    def fold(s: Column) -> Column:
        return F.struct(s.alias("state"), _folded(s["filtered"]).alias("folded"))

    current = F.transform(F.transform(F.array(current), fold), builtin)[0]
    for pattern in custom:
        current = regex_stage(current, pattern.id, pattern.jvm, pattern.replacement)
    return current


def with_redaction(
    df: DataFrame, column: str, rules: RedactionRules = RedactionRules(), filtered: str = "filtered", detections: str = "detections"
) -> DataFrame:
    """Add the redacted text and its detections."""
    return df.withColumn("_found", redaction(F.col(column), rules)).withColumns(
        {filtered: F.col("_found.filtered"), detections: F.col("_found.detections")}
    ).drop("_found")


def _python_filter(rules: RedactionRules) -> Callable[[str], tuple[str, list[str]]]:
    stages = [(p.id, p.python, p.python_replacement) for p in [*BUILTIN, *rules.usable_custom()]]
    allowed = [re.compile(a) for a in rules.allow if a]

    def run(text: str) -> tuple[str, list[str]]:
        found: list[str] = []
        for secret in rules.secrets:
            if secret and secret in text:
                found.append("explicit_secret")
                text = text.replace(secret, REDACTED)
        for pattern_id, regex, replacement in stages:

            def swap(match: re.Match) -> str:
                hit = match.group(0)
                if any(a.search(hit) for a in allowed):
                    return hit
                found.append(pattern_id)
                return regex.sub(replacement, hit, count=1)

            text = regex.sub(swap, text)
        return text, found

    return run


def _python_redaction(text: Column, rules: RedactionRules) -> Column:
    """``redaction`` by Python's patterns."""
    run = _python_filter(rules)

    @F.pandas_udf("filtered string, detections array<string>")
    def apply(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, []) if t is None else run(t) for t in texts]
        return pd.DataFrame(rows, columns=["filtered", "detections"])

    def counted(r: Column) -> Column:
        entry = F.transform(
            F.array_sort(F.array_distinct(r["detections"])),
            lambda p: F.struct(p.alias("pattern_id"), F.size(F.filter(r["detections"], lambda d: d == p)).alias("count")),
        )
        return F.struct(r["filtered"].alias("filtered"), entry.alias("detections"))

    return F.transform(F.array(apply(text)), counted)[0]


def redacted_json(text: Column, rules: RedactionRules = RedactionRules(), blank_env: bool = True) -> Column:
    """JSON text with its string leaves filtered. Text that holds nothing of what a match needs stays as
    it is, inside the JVM; only the rest goes to Python."""
    possible = rules.may_find(text, blank_env)
    return F.when(possible, redact_json(rules, blank_env)(F.when(possible, text))["filtered"]).otherwise(text)


def redact_json(rules: RedactionRules = RedactionRules(), blank_env: bool = True):
    """Arrow UDF over JSON text of any shape: every string leaf is filtered; invalid JSON as text."""
    run = _python_filter(rules)

    def walk(value, found):
        if isinstance(value, str):
            text, hits = run(value)
            found.extend(hits)
            return text
        if isinstance(value, dict):
            return {k: walk(v, found) for k, v in value.items()}
        if isinstance(value, list):
            return [walk(v, found) for v in value]
        return value

    def one(text: str) -> tuple[str, list[str]]:
        try:
            document = json.loads(text)
        except ValueError:
            return run(text)
        found: list[str] = []
        document = walk(document, found)
        runtime = document.get("runtime") if isinstance(document, dict) else None
        env = runtime.get("env_vars") if isinstance(runtime, dict) else None
        if blank_env and isinstance(env, dict):
            for name in rules.env_names:
                if name in env:
                    env[name] = REDACTED
                    found.append(f"env_var:{name}")
        return json.dumps(document), found

    @F.pandas_udf("filtered string, detections array<string>")
    def apply(texts: pd.Series) -> pd.DataFrame:
        rows = [(t, []) if not t else one(t) for t in texts]
        return pd.DataFrame(rows, columns=["filtered", "detections"])

    return apply


def blank_environment(env: Column, names: Sequence[str] = ENV_NAMES) -> Column:
    """Blank the values of the named environment variables in a map column."""
    listed = F.array(*[F.lit(n) for n in names])
    return F.transform_values(env, lambda k, v: F.when(F.array_contains(listed, k), REDACTED).otherwise(v))
