"""Predicates and profiles of a case's texts, as JVM-side Columns; a null text is empty."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon
from .text import compact, fact_count, gram_containment, let, safe, split_items


def matches(c: Column, pattern: str) -> Column:
    return safe(c).rlike(f"(?i){pattern}")


def guarded(pattern: str) -> str:
    """A pattern of whole words with a test of their first two letters before it, as most words pass none of its alternatives.

    Only patterns of the form \\b(one|another|...)\\b gain it, whose alternatives begin with two plain characters.
    """
    inner = re.fullmatch(r"\\b\((.*)\)\\b", pattern)
    words = re.sub(r"\([^()]*\)", "", inner[1]).split("|") if inner else []
    if not words or not all(re.match(r"[a-z][a-z&](?![?*])", w) for w in words):
        return pattern
    return rf"\b(?=[{''.join(sorted({w[0] for w in words}))}][{''.join(sorted({w[1] for w in words}))}])({inner[1]})\b"


def matching(c: Column, patterns: Mapping[str, str]) -> Column:
    """Names of the patterns (in lower case) found, in their order."""
    low = lambda t: F.array_compact(F.array(*[F.when(t.rlike(guarded(p)), F.lit(n)) for n, p in patterns.items()]))
    return let(F.lower(safe(c)), low)


def pattern_flags(c: Column, families: Mapping[str, Sequence[str]]) -> list[Column]:
    """One boolean column a family of patterns, over the lower-cased text."""
    return [F.lower(safe(c)).rlike("|".join(f"(?:{p})" for p in patterns)).alias(name) for name, patterns in families.items()]


def leakage_reasons(facts: Column, decision: Column, size: int = 6, threshold: float = 0.12) -> Column:
    """Names of outcome patterns in the facts, and judgment_text_overlap where they hold a share of the decision's n-grams."""
    overlap = F.coalesce(gram_containment(decision, facts, size) >= threshold, F.lit(False))
    return F.concat(matching(facts, lexicon.OUTCOME_PATTERNS), F.when(overlap, F.array(F.lit("judgment_text_overlap"))).otherwise(F.array().cast("array<string>")))


def is_civil(plaintiff: Column, kind: Column, claim: Column) -> Column:
    return (F.upper(compact(plaintiff)) != "HKSAR") & ~matches(F.concat_ws(" ", safe(kind), safe(claim)), lexicon.CRIMINAL_TERMS)


def strict_reasons(facts: Column) -> Column:
    return F.when(matches(facts, lexicon.STRICT_TERMS), F.array(F.lit("strict_judicial_or_evaluative_language"))).otherwise(F.array().cast("array<string>"))


def has_defense(issues: Column) -> Column:
    return matches(issues, lexicon.DEFENSE_FLAG)


def issue_lines(issues: Column) -> Column:
    """Number of lines that are not blank."""
    return F.size(F.filter(F.split(safe(issues), r"\R"), lambda x: F.btrim(x) != ""))


def issue_questions(issues: Column) -> Column:
    """Number of parts between line breaks, and semicolons before a question word; at least 1 unless blank."""
    parts = F.filter(F.split(safe(issues), r"\n|;(?=\s*(?:whether|if|what|the)\b)"), lambda x: F.btrim(x) != "")
    return F.when(F.btrim(safe(issues)) == "", 0).otherwise(F.greatest(F.size(parts), F.lit(1)))


def issue_bucket(count: Column) -> Column:
    return F.when(count == 0, "none").when(count <= 2, "few").otherwise("many")


def authority_bucket(laws: Column, cases: Column) -> Column:
    return F.when((laws > 0) & (cases > 0), "laws_and_cases").when(laws > 0, "laws_only").when(cases > 0, "cases_only").otherwise("no_authorities")


def demands(words: Column, families: Column, issues: Column, laws: Column, cases: Column, facts: Column, characters: Column) -> Column:
    """What a case demands: by its number of issues, laws, precedents and facts, then by its words (names of the demand patterns found)."""
    first = F.when(issues == 0, "issue_spotting_gap").when(issues == 1, "focused_issue_resolution").when(issues >= 3, "multi_issue_composition").otherwise("dual_issue_resolution")
    found = [
        first,
        F.when(laws > 0, "supplied_rule_extraction").otherwise("rule_recall_or_doctrine_identification"),
        F.when(cases > 0, "precedent_or_analogy_handling"),
        F.when(F.array_contains(families, "procedure_appeal"), "procedural_threshold_check"),
        *[F.when(F.array_contains(words, n), F.lit(n)) for n in lexicon.DEMAND_PATTERNS],
        F.when((facts >= 12) | (characters >= 2200), "long_fact_filtering"),
    ]
    return F.array_compact(F.array(*found))


def trajectory(families: Column, wanted: Column) -> Column:
    """Steps that follow from families (three at most) and demands."""
    has = lambda name: F.array_contains(wanted, name)
    when = lambda steps: [F.when(has(d), F.lit(s)) for d, s in steps]
    start = [F.lit("case_profile"), F.when(has("issue_spotting_gap"), "issue_spotting").when(has("multi_issue_composition"), "issue_decomposition").otherwise("issue_confirmation")]
    rule = F.when(has("supplied_rule_extraction"), "rule_extraction").otherwise("rule_or_doctrine_identification")
    domain = F.transform(F.slice(families, 1, 3), lambda f: F.concat(F.lit("domain_template:"), f))
    return F.concat(F.array_compact(F.array(*start, *when(lexicon.STEPS_BEFORE), rule)), domain, F.array_compact(F.array(*when(lexicon.STEPS_AFTER), F.lit("final_decision"))))


def profile(facts: Column, issues: Column, laws: Column, cases: Column, *other: Column) -> Column:
    """struct of counts, families, demands and trajectory of a case; other: further texts that are searched for patterns."""
    text = F.concat_ws(" ", *[safe(c) for c in (*other, facts, issues, laws, cases)])
    found = matching(text, lexicon.FAMILY_PATTERNS | lexicon.DEMAND_PATTERNS)
    base = F.struct(found.alias("found"), F.size(split_items(issues)).alias("issues"), F.size(split_items(laws)).alias("laws"), F.size(split_items(cases)).alias("cases"), F.when(compact(facts) == "", 0).otherwise(fact_count(facts)).alias("facts"), F.length(safe(facts)).alias("characters"))

    def families_of(b: Column) -> Column:
        hits = F.filter(b["found"], lambda x: x.isin(list(lexicon.FAMILY_PATTERNS)))
        return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("general_legal_reasoning")))

    def out(b: Column, f: Column, d: Column) -> Column:
        t = trajectory(f, d)
        return F.struct(b["issues"].alias("issue_count"), b["laws"].alias("law_count"), b["cases"].alias("case_count"), b["facts"].alias("fact_count"), b["characters"].alias("fact_characters"), f.alias("families"), d.alias("demands"), t.alias("trajectory"), F.array_join(t, " > ").alias("signature"))

    wanted = lambda b, f: demands(b["found"], f, b["issues"], b["laws"], b["cases"], b["facts"], b["characters"])
    return let(base, lambda b: let(families_of(b), lambda f: let(wanted(b, f), lambda d: out(b, f, d))))


def demand_focus(wanted: Column, priority: Sequence[str], default: str = "general_resolution") -> Column:
    """The first of the priorities that is among the demands."""
    return F.coalesce(F.get(F.filter(F.array(*[F.lit(p) for p in priority]), lambda p: F.array_contains(wanted, p)), 0), F.lit(default))


def signature_prefix(signature: Column, steps: int = 5) -> Column:
    parts = F.filter(F.transform(F.split(safe(signature), " > "), F.btrim), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, steps), " > ")).otherwise("unknown")


def safe_name(c: Column, width: int = 80) -> Column:
    """A label as part of a file's name."""
    return F.substring(F.lower(F.btrim(F.regexp_replace(safe(c), "[^a-zA-Z0-9_]+", "_"), F.lit("_"))), 1, width)


def numbered_authorities(*texts: Column) -> Column:
    """array of (id, text): lines of the texts without ' \\t-*;' at both ends, each once, numbered A1, A2, ..."""
    lines = F.flatten(F.array(*[F.transform(F.split(safe(t), r"[\r\n]+"), lambda x: F.btrim(x, F.lit(" \t-*;"))) for t in texts]))
    unique = F.array_distinct(F.filter(lines, lambda x: x != ""))
    return F.transform(unique, lambda x, i: F.struct(F.concat(F.lit("A"), (i + 1).cast("string")).alias("id"), x.alias("text")))


def valid_ids(ids: Column, known: Column) -> Column:
    """The known ones of ids, each once, in their order."""
    return F.array_intersect(F.coalesce(ids, F.array().cast("array<string>")), known)


def equal_structures(a: Column, b: Column) -> Column:
    """Whether two answers are JSON objects or lists of equal content, whatever their spacing and order of keys."""
    shaped = lambda c: F.btrim(safe(c)).rlike(r"^[\[{]")
    plain = lambda c: F.try_parse_json(F.btrim(safe(c))).cast("string")
    return F.when(shaped(a) & shaped(b), F.coalesce(plain(a) == plain(b), F.lit(False))).otherwise(False)


def answers_match(a: Column, b: Column) -> Column:
    from .text import normalize_answer

    return (normalize_answer(a) == normalize_answer(b)) | equal_structures(a, b)
