"""Text expressions: tagging, classification, titles, sections, phrases."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from memograph import vocab

MENTION_TYPE = "array<struct<name:string,type:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expensive value once; naming it twice in plain columns would evaluate it twice."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def collapse(c: Column) -> Column:
    """Lower case with single spaces: the duplicate key of a text."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def isin(c: Column, values: Sequence[str]) -> Column:
    return c.isin(list(values))


def _lookup(words: dict[str, tuple[str, str]]) -> Column:
    cells: list[Column] = []
    for word, (name, kind) in words.items():
        cells += [F.lit(word), F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"))]
    return F.create_map(*cells)


def dictionary(projects: Sequence[str] = vocab.PROJECT_WORDS) -> dict[str, tuple[str, str]]:
    words: dict[str, tuple[str, str]] = {}
    for w in projects:
        words[w] = (w.capitalize(), "project")
    for w in vocab.CONCEPT_WORDS:
        words[w] = (w, "operational_concept")
    for w in vocab.PRODUCT_WORDS:
        words[w] = (w.capitalize(), "product")
    for w in vocab.ENVIRONMENT_WORDS:
        words[w] = (w, "environment")
    for w in vocab.SYSTEM_WORDS:
        words[w] = ("PostgreSQL" if w.startswith("postgres") else w.capitalize(), "system")
    for w in vocab.TEAM_WORDS:
        words[w] = (w.capitalize(), "team")
    return words


def whole_words(words: Sequence[str]) -> str:
    """Pattern for dictionary words standing as whole tokens of letters, digits, underscores and hyphens.

    Equal to cutting the text into tokens and looking each one up, without a
    string per token. Hyphens at a token's edge belong to no word.
    """
    inside = r"\p{L}\p{N}_\-"
    longest_first = sorted(words, key=lambda w: (-len(w), w))
    return rf"(?<![{inside}])-*({'|'.join(longest_first)})-*(?![{inside}])"


def mentions(text: Column, projects: Sequence[str] = vocab.PROJECT_WORDS) -> Column:
    """Entity mentions in rule order then position, case-insensitively distinct, first case kept."""

    def typed(found: Column, kind: str) -> Column:
        return F.transform(found, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type")))

    words = dictionary(projects)
    table = _lookup(words)
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(whole_words(list(words))), F.lit(1)))
    known = F.transform(tokens, lambda t: F.element_at(table, t))

    def assemble(named: Column) -> Column:
        return F.concat(
            typed(F.regexp_extract_all(text, F.lit(vocab.PROJECT_PATTERN), F.lit(1)), "project"),
            typed(F.regexp_extract_all(text, F.lit(vocab.INCIDENT_PATTERN), F.lit(1)), "incident"),
            typed(F.regexp_extract_all(text, F.lit(vocab.MENTION_PATTERN), F.lit(1)), "person"),
            F.filter(named, lambda m: m["type"] != "project"),
            F.filter(named, lambda m: m["type"] == "project"),
        )

    return first_by_name(let(known, assemble))


def first_by_name(found: Column) -> Column:
    """Keep the first mention of every name, comparing names without case."""
    keyed = F.transform(
        found, lambda m, i: F.struct(F.lower(m["name"]).alias("key"), i.alias("at"), m["name"].alias("name"),
                                     m["type"].alias("type"))
    )

    def firsts(ranked: Column) -> Column:
        shifted = F.concat(F.array(F.lit(None).cast("struct<key:string,at:int,name:string,type:string>")), ranked)
        return F.filter(
            F.zip_with(ranked, F.slice(shifted, F.lit(1), F.size(ranked)),
                       lambda cur, prev: F.when(prev.isNull() | (prev["key"] != cur["key"]), cur)),
            lambda m: m.isNotNull(),
        )

    in_order = F.array_sort(F.transform(
        let(F.array_sort(keyed), firsts),
        lambda m: F.struct(m["at"].alias("at"), m["name"].alias("name"), m["type"].alias("type"))))
    return F.transform(in_order, lambda m: F.struct(m["name"].alias("name"), m["type"].alias("type")))


def chunk_event_type(text: Column, source: Column) -> Column:
    low = F.lower(text)
    kind = None
    for name, words in vocab.CHUNK_EVENT_WORDS:
        hit = contains_any(low, words)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return kind.when((source == "slack") & (F.length(text) > 40), "discussion")


def chunk_event_title(kind: Column, title: Column) -> Column:
    name = F.coalesce(F.when(title != "", title), F.lit("discussion"))
    low = F.lower(name)
    return (
        F.when((kind == "incident") & ~contains_any(low, ["incident", "outage"]),
               F.concat(F.lit("Incident: "), name))
        .when((kind == "deployment") & ~contains_any(low, ["deploy", "release"]),
              F.concat(F.lit("Deployment/Release: "), name))
        .otherwise(name)
    )


def leading_sentences(text: Column) -> Column:
    """First two sentences, at most 200 characters."""
    pieces = F.filter(
        F.transform(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), r"\."), lambda s: strip(s)), lambda s: s != ""
    )
    return let(F.array_join(F.slice(pieces, 1, 2), ". "), lambda lead: (
        F.when(lead == "", F.substring(text, 1, 200))
        .when(F.length(lead) > 200, F.concat(F.substring(lead, 1, 197), F.lit("...")))
        .otherwise(lead)
    ))


def event_teams(team: Column, entities: Column) -> Column:
    own = F.when(team != "unknown", F.array(team)).otherwise(F.array().cast("array<string>"))
    named = F.filter(entities, lambda e: F.lower(e).contains("team") | e.isin(vocab.TEAM_NAMES_IN_EVENTS))
    return F.array_distinct(F.concat(own, F.transform(named, lambda e: F.element_at(F.split(e, " "), 1))))


def line_event_type(line: Column) -> Column:
    """First matching rule; one pass with all rules joined skips the many lines none matches."""
    any_rule = "(?i)" + "|".join(pattern for _, pattern in vocab.LINE_EVENT_PATTERNS)
    kind = F.when(~line.rlike(any_rule), F.lit(None).cast("string"))
    for name, pattern in vocab.LINE_EVENT_PATTERNS:
        kind = kind.when(line.rlike("(?i)" + pattern), name)
    return kind


def line_timestamp(line: Column) -> Column:
    found = F.replace(F.regexp_extract(line, vocab.LINE_DATE_PATTERN, 1), F.lit("/"), F.lit("-"))
    return F.try_to_timestamp(found)


def clip(text: Column, size: int = 100) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 3), F.lit("..."))).otherwise(text)


def event_type_or_default(v: Column) -> Column:
    low = strip(F.lower(v))
    return (
        F.when(low.isin(vocab.EVENT_TYPES), low)
        .when(contains_any(low, ["incident", "outage"]), "incident")
        .otherwise("decision")
    )


def severity_or_null(v: Column) -> Column:
    low = strip(F.lower(v))
    return F.when(low.isin(vocab.SEVERITIES), low)


def edge_type_or_default(v: Column, known: Sequence[str]) -> Column:
    low = F.translate(strip(F.lower(v)), " -", "__")
    return F.when(low.isin(list(known)), low).otherwise("related_to")


def entity_type_or_document(v: Column) -> Column:
    low = strip(F.lower(v))
    return F.when(low.isin(vocab.ENTITY_TYPES), low).otherwise("document")


def clamp_confidence(v: Column, default: float = 0.8) -> Column:
    number = v.try_cast("double")
    # greatest and least skip nulls, so an unreadable number is settled first.
    return F.when(number.isNull(), default).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def entity_name_or_null(v: Column) -> Column:
    """The whole name, since it is a key; cut it only for display."""
    name = strip(v)
    return F.when(F.length(name) >= 2, name)


def title_keywords(title: Column) -> Column:
    """Words of a title that may name a recurring issue; repeats are kept."""
    words = F.filter(F.split(F.lower(title), r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.btrim(w, F.lit(vocab.TITLE_PUNCTUATION)))
    return F.filter(bare, lambda w: (F.length(w) > 2) & ~w.isin(vocab.TITLE_STOP_WORDS))


def without_generic(entities: Column) -> Column:
    return F.filter(entities, lambda e: ~F.lower(e).isin(vocab.GENERIC_ENTITIES))


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def routed_team(keyword: Column) -> Column:
    return (
        F.when(keyword.isin(vocab.BILLING_KEYWORDS), "Billing Integration Team")
        .when(keyword.isin(vocab.DATABASE_KEYWORDS), "Database Ops Team")
        .otherwise("Infrastructure Platform Team")
    )


def routed_assignee(keyword: Column) -> Column:
    return (
        F.when(keyword.isin(vocab.BILLING_KEYWORDS), "Billing Engineer")
        .when(keyword.isin(vocab.DATABASE_KEYWORDS), "DB Reliability Engineer")
        .otherwise("On-Call Engineer")
    )


def alert_severity(level: Column) -> Column:
    low = F.lower(level)
    out = None
    for name, severity in vocab.ALERT_SEVERITY.items():
        out = F.when(low == name, severity) if out is None else out.when(low == name, severity)
    return out.otherwise("high")


def alias_list(csv: Column) -> Column:
    return F.filter(F.transform(F.split(csv, ","), lambda a: strip(a)), lambda a: a != "")


def tokens(name: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def clock_delay(seconds: Column) -> Column:
    """Delay as minutes and seconds."""
    whole = F.floor(seconds)
    return F.concat(F.floor(whole / 60), F.lit("m "), whole % 60, F.lit("s"))


def duration_text(seconds: Column) -> Column:
    """Rounded-down human duration with at most two units."""
    s = F.floor(seconds)
    return (
        F.when(s < 60, F.concat(s, F.lit("s")))
        .when(s < 3600, F.concat(F.floor(s / 60), F.lit("m")))
        .when(s < 86400, F.concat(F.floor(s / 3600), F.lit("h "), F.floor(s / 60) % 60, F.lit("m")))
        .otherwise(F.concat(F.floor(s / 86400), F.lit("d "), F.floor(s / 3600) % 24, F.lit("h")))
    )


def section(text: Column, heads: str, stops: str) -> Column:
    """Text after a labelled head up to the next label, or empty."""
    return F.trim(F.regexp_extract(text, rf"(?i)(?:{heads}):\s*(.*?)(?=(?:{stops}|$))", 1))


def report_sections(content: Column) -> Column:
    """Struct of root cause, impact and remediation of a labelled report, with defaults."""
    flat = F.trim(F.regexp_replace(F.substring(content, 1, 800), r"\s+", " "))
    flat = F.trim(F.regexp_replace(
        flat, r"(?i)^Root\s+cause\s+details\s+for\s+query\s+'.*?'\s+were\s+identified\s+in\s+.*?:", ""))
    quoted = flat.startswith('"') & flat.endswith('"') & (F.length(flat) > 1)
    flat = F.when(quoted, F.trim(F.substring(flat, F.lit(2), F.length(flat) - 2))).otherwise(flat)
    # Section labels and default sentences.
    cause = section(flat, r"Root\s+Cause", r"Observed\s+Effects:|Actions\s+Taken:")
    impact = section(flat, r"Observed\s+Effects|Impact", r"Actions\s+Taken|Root\s+Cause:")
    remedy = section(flat, r"Actions\s+Taken|Remediation", r"Root\s+Cause:|Observed\s+Effects:")
    return F.struct(
        F.when(cause != "", cause).otherwise(
            F.concat(F.lit("Telemetry alert matches context: "), F.substring(flat, 1, 150), F.lit("..."))
        ).alias("root_cause"),
        F.when(impact != "", impact).otherwise("Service latency and authentication errors.").alias("impact"),
        F.when(remedy != "", remedy).otherwise(
            "Apply recent patch, verify connection pools, and run diagnostics."
        ).alias("remediation"),
    )
