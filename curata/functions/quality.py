"""Quality and sensitive-content detectors as column expressions: codes and counts, never the matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import udfs
from curata.functions.identity import blank, lines

FIDELITY, TECHNICAL, SUITABILITY = "extraction_fidelity", "technical_correctness", "training_suitability"

# Detectors by one pattern over the whole text: code, category, severity, pattern.
PATTERNS = [
    ("SOURCE_VISUAL_PLACEHOLDER", SUITABILITY, "critical", r"(?i)\[(?:pic(?:ture)?|image|diagram|figure)\s+(?:goes|insert|here)|\b(?:insert|missing)\s+(?:diagram|image|figure)\b"),
    ("REPLACEMENT_CHARACTERS", FIDELITY, "critical", r"\x{FFFD}"),
    ("MOJIBAKE", FIDELITY, "critical", r"Ã[\x{80}-\x{bf}]|Â[\x{80}-\x{bf}]|â[€‚„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|ðŸ|ï¿½"),
    ("PRIVATE_USE_GLYPHS", FIDELITY, "critical", r"\p{Co}"),
    ("CONTROL_CHARACTERS", FIDELITY, "major", r"[\x{00}-\x{08}\x{0b}\x{0d}-\x{1f}\x{7f}-\x{9f}]"),
    ("INVISIBLE_FORMATTING", FIDELITY, "major", r"[\x{200b}\x{202a}-\x{202e}\x{2066}-\x{2069}]"),
    ("AMBIGUOUS_HYPHENATION", FIDELITY, "major", r"\p{L}-\n\s*\p{L}|\x{ad}"),
]
# Detectors by one pattern over each line: code, category, severity, pattern, math lines only.
LINE_PATTERNS = [
    ("INCOMPLETE_MATH", TECHNICAL, "critical", r"(?:[=+*/^−-]|\\(?:frac|sqrt|cdot|times))\s*$", True),
    ("EMPTY_MATH_ARGUMENT", TECHNICAL, "critical", r"\\(?:frac|sqrt)\s*\{\s*\}|\\frac\s*\{[^{}]*\}\s*\{\s*\}|(?:\^|_)\s*\{\s*\}", True),
    ("BROKEN_UNIT_EXPONENT", TECHNICAL, "critical", r"\b(?:m|cm|mm|km|s|kg|N|J|Pa|W|Hz|V|A)\s*[\^_]\s*(?:$|[.,;])", False),
]
# Line detectors with look-around or back references, which RE2 lacks.
LOOKING_PATTERNS = [
    ("SPACED_LETTER_FRAGMENTS", FIDELITY, "major", r"(?<!\w)(?:[A-Za-z] ){4,}[A-Za-z](?!\w)", False),
    ("GARBLED_SYMBOL_RUN", FIDELITY, "major", r"([^\p{L}\p{N}_\s])\1{5,}", False),
    ("OCR_NUMERIC_CONFUSION", TECHNICAL, "critical", r"(?<![A-Za-z])(?:[0-9]+[OlI][0-9]*|[OlI][0-9]+)(?![A-Za-z])", True),
]
# Lines that hold mathematics, hints and headings, by pattern.
MATH_LINE = r"[=≈≤≥∑∫√]|\\[(\[]|\$|\\(?:frac|sqrt|sum|int|prod)\b|\\(?:begin|end|alpha|beta|theta|sigma|pi|cdot|times)\b"
TRUNCATED_HINT = r"(?i)\b(?:and|or|because|therefore|where|given|such that|equals)\s*$"
HEADING_ONLY = r"(?i)^\s*(?:problem|question|exercise|solution|answer)\s*(?:\d+)?\s*[:.]?\s*$"
QUESTION_NUMBER = r"(?i)^\s*(?:Question\s+|Problem\s+)(\d{1,5})\b"
PROBLEM, SOLUTION = r"(?im)^\s*(?:problem|question|exercise)\b", r"(?im)^\s*(?:solution|answer|worked solution)\b"
MONETARY = r"^[^$]*\$\d[\d,.]*(?:\s+[^$]*)?$"
# Sensitive content by pattern; any pattern of a code is enough.
SENSITIVE = {
    "POSSIBLE_SECRET": [
        r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
        r"\bAKIA[A-Z0-9]{16}\b",
        r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{30,})\b",
        r"\bsk-(?:proj-|svcacct-)?[A-Za-z0-9_-]{24,}\b",
        r"(?i)\b(?:api[_ -]?key|access[_ -]?token|client[_ -]?secret|password)\s*[:=]\s*[\"']?[A-Za-z0-9_./+\-=]{16,}",
        r"(?i)\bBearer\s+[A-Za-z0-9_.~+/-]{24,}=*",
    ],
    "LOGIN_CREDENTIALS": [r"(?im)\b(?:password|passwd|pwd|passphrase)\s*[:=]\s*[\"']?[^\s\"']{3,}"],
    "BANK_ROUTING_NUMBER": [r"(?i)\b(?:routing(?:\s+(?:number|no\.?|#))?|aba(?:\s+(?:number|routing))?)\s*[:=#-]?\s*\d(?:[ -]?\d){8}\b"],
    "BANK_ACCOUNT_NUMBER": [
        r"(?i)\b(?:(?:bank|checking|savings)\s+(?:account\s*)?(?:number|no\.?|#)?|account\s+(?:number|no\.?|#)|acct\.?\s*(?:number|no\.?|#)?)\s*[:=#-]?\s*\d(?:[ -]?\d){5,19}\b",
        r"(?i)\bIBAN\s*[:=#-]?\s*[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){10,30}\b",
    ],
    "POSSIBLE_SSN": [r"\b\d{3}-\d{2}-\d{4}\b", r"(?i)\b(?:SSN|social\s+security(?:\s+(?:number|no\.?))?)\s*[:=#-]?\s*\d(?:[ -]?\d){8}\b"],
    "MEDICAL_RECORD_IDENTIFIER": [r"(?i)\b(?:MRN|medical\s+record\s*(?:number|no\.?|#)|patient\s+(?:id|identifier|number|no\.?))\s*[:=#-]?\s*[A-Z0-9][A-Z0-9-]{3,}\b"],
}
# Parts of combined findings, by pattern.
EMAIL = r"\b[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PATIENT = r"(?im)^\s*(?:patient\s+name|patient|name)\s*:\s*[A-Z][A-Za-z'-]+(?:\s+[A-Z][A-Za-z'-]+)+"
CLINICAL = r"(?im)^\s*(?:diagnosis|medications?|date\s+of\s+birth|DOB|treatment|chief\s+complaint)\s*:"
# Flags of whole records.
RECORD_FLAGS = {
    "EMBEDDED_TRAINING_CONTROL_TOKENS": r"<\||\[INST\]",
    "PLACEHOLDER_RESPONSE": r"(?i)\b(?:TODO|TBD|INSERT ANSWER|your answer here)\b",
    "VISUAL_OR_TABLE_DEPENDENCY_REVIEW": r"(?i)(?:above|below|following|attached)\s+(?:figure|graph|diagram|image|table)|(?:figure|diagram|graph)\s+\d",
}
SENSITIVE_CODES = [*SENSITIVE, "EMAIL_AND_PASSWORD", "PERSONAL_MEDICAL_RECORD"]


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def normalized(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``text`` in LF and NFC, and an audit: ``n_crlf``, ``n_cr``, ``nfc_changed``."""
    raw = F.col(text)
    n = df.withColumn("n_crlf", F.regexp_count(raw, F.lit("\r\n"))).withColumn("n_cr", F.regexp_count(raw, F.lit("\r")) - F.col("n_crlf"))
    n = n.withColumn("_lf", normalize_newlines(raw)).withColumn("_nfc", udfs.nfc("_lf"))
    return n.withColumn("nfc_changed", F.col("_nfc") != F.col("_lf")).withColumn(text, F.col("_nfc")).drop("_lf", "_nfc")


def sensitive_codes(c: Column) -> Column:
    """Sorted codes of sensitive content; nothing of the content itself."""
    hit = {code: [c.rlike(p) for p in ps] for code, ps in SENSITIVE.items()}
    any_ = {code: _any(h) for code, h in hit.items()}
    any_["EMAIL_AND_PASSWORD"] = any_["LOGIN_CREDENTIALS"] & c.rlike(EMAIL)
    any_["PERSONAL_MEDICAL_RECORD"] = c.rlike(PATIENT) & c.rlike(CLINICAL)
    return F.array_sort(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in any_.items()])))


def record_flags(c: Column) -> Column:
    return F.array_sort(F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(k)) for k, p in RECORD_FLAGS.items()])))


def _any(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out | c
    return out


def math_lines(c: Column) -> Column:
    return F.filter(lines(c), lambda x: x.rlike(MATH_LINE))


def issue_counts(c: Column, looking: bool = True) -> list[tuple[str, str, str, Column]]:
    """``(code, category, severity, count)`` of every detector that built-in expressions can state."""
    every, math = lines(c), math_lines(c)
    hits = lambda ls, p: F.size(F.filter(ls, lambda x: x.rlike(p)))
    out = [("EMPTY_TEXT", FIDELITY, "critical", blank(c).cast("int"))]
    out += [(code, cat, sev, F.regexp_count(c, F.lit(p))) for code, cat, sev, p in PATTERNS]
    out += [(code, cat, sev, hits(math if m else every, p)) for code, cat, sev, p, m in LINE_PATTERNS]
    full = F.filter(F.transform(every, lambda x: F.length(F.trim(x))), lambda n: n > 0)
    short = F.size(F.filter(full, lambda n: n <= 3))
    out.append(("FRAGMENTED_LINES", FIDELITY, "major", F.when((F.size(full) >= 8) & (short / F.size(full) > 0.45), short).otherwise(0)))
    numbers = F.transform(F.filter(every, lambda x: x.rlike(QUESTION_NUMBER)), lambda x: F.regexp_extract(x, QUESTION_NUMBER, 1).cast("int"))
    back = F.size(F.filter(F.zip_with(numbers, F.slice(numbers, 2, 100_000_000), lambda a, b: b < a), lambda x: x))
    out.append(("READING_ORDER_HINT", FIDELITY, "major", F.when(F.size(numbers) > 1, back).otherwise(0)))
    money = F.replace(c, F.lit("\\$"), F.lit(""))
    double = F.regexp_count(money, F.lit(r"\$\$"))
    single = F.replace(money, F.lit("$$"), F.lit(""))
    odd = (F.regexp_count(single, F.lit(r"\$")) % 2 == 1) & ~single.rlike(MONETARY)
    out.append(("UNBALANCED_MATH_DELIMITERS", TECHNICAL, "critical", ((double % 2 == 1) | odd).cast("int")))
    out.append(("UNBALANCED_MATH_DELIMITERS", TECHNICAL, "critical", _delimiters(c, r"\(", r"\)") + _delimiters(c, r"\[", r"\]")))
    out.append(("TRUNCATED_SENTENCE_HINT", FIDELITY, "major", F.rtrim(c).rlike(TRUNCATED_HINT).cast("int")))
    out.append(("EMPTY_EDUCATIONAL_SECTION", SUITABILITY, "critical", F.element_at(lines(F.regexp_replace(c, r"\s+$", "")), -1).rlike(HEADING_ONLY).cast("int")))
    if looking:
        out += [(code, cat, sev, hits(math if m else every, p)) for code, cat, sev, p, m in LOOKING_PATTERNS]
        words = F.regexp_extract_all(c, F.lit(r"\b[A-Za-z]{5,}\b"), F.lit(0))
        out.append(("GARBLED_WORDS", FIDELITY, "major", F.size(F.filter(words, lambda w: w.rlike(r"(?i)(.)\1{4,}")))))
    return out


def _delimiters(c: Column, opening: str, closing: str) -> Column:
    """1 if TeX delimiters are unpaired or nested: a fold that keeps the depth, or 99 once it went wrong."""
    marks = F.regexp_extract_all(c, F.lit("\\\\[" + opening[1:].replace("[", "\\[") + closing[1:].replace("]", "\\]") + "]"), F.lit(0))
    step = lambda d, m: F.when(d == 99, 99).when(m == opening, F.when(d == 1, 99).otherwise(d + 1)).otherwise(F.when(d == 0, 99).otherwise(d - 1))
    return (F.aggregate(marks, F.lit(0), step) != 0).cast("int")


def inspect(df: DataFrame, text: str = "text", context: dict[str, Column] | None = None, looking: bool = True, exact: bool = False) -> DataFrame:
    """``df`` with ``checks``: array of (code, category, severity, count) of all detectors that fired.

    ``context`` may give columns ``expected_problem``, ``expected_solution``,
    ``problem_complete``, ``solution_complete``, ``ocr_confidence``. ``exact``
    adds the detectors that need Python (bracket stacks, environments, exact
    arithmetic). Null texts count as empty.
    """
    ctx = context or {}
    d = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    found = issue_counts(F.col("_t"), looking)
    t = F.col("_t")
    no = F.lit(False)
    yes = lambda k: F.coalesce(ctx.get(k, F.lit(None).cast("boolean")), no)
    if ctx:
        for k, p in (("problem", PROBLEM), ("solution", SOLUTION)):
            found.append((f"{k.upper()}_NOT_ESTABLISHED", SUITABILITY, "major", (yes(f"expected_{k}") & ~t.rlike(p) & ~yes(f"{k}_complete")).cast("int")))
            if f"{k}_complete" in ctx:
                found.append((f"INCOMPLETE_{k.upper()}", SUITABILITY, "critical", F.coalesce(~ctx[f"{k}_complete"], no).cast("int")))
        if "ocr_confidence" in ctx:
            v = ctx["ocr_confidence"]
            found.append(("LOW_OCR_CONFIDENCE", FIDELITY, "major", F.coalesce((v >= 0) & (v < 0.90), no).cast("int")))
    if exact:
        d = d.withColumn("_m", math_lines(t)).withColumn("_eq", udfs.equalities("_m")).withColumn("_br", udfs.unbalanced_brackets("_t")).withColumn("_env", udfs.unbalanced_environments("_t"))
        found += [
            ("UNBALANCED_LATEX_ENVIRONMENT", TECHNICAL, "critical", F.col("_env").cast("int")),
            ("UNBALANCED_MATH_BRACKETS", TECHNICAL, "critical", (F.col("_br") & (F.size("_m") > 0)).cast("int")),
            ("NUMERIC_EQUALITY_MISMATCH", TECHNICAL, "critical", F.col("_eq.wrong")),
        ]
    sens = F.transform(sensitive_codes(t), lambda s: F.struct(s.alias("code"), F.lit(SUITABILITY).alias("category"), F.lit("critical").alias("severity"), F.lit(1).alias("count")))
    own = [F.when(n > 0, F.struct(F.lit(a).alias("code"), F.lit(b).alias("category"), F.lit(s).alias("severity"), n.cast("int").alias("count"))) for a, b, s, n in found]
    return d.withColumn("checks", F.concat(F.array_compact(F.array(*own)), sens)).drop("_t", "_m", "_eq", "_br", "_env")


def statuses(df: DataFrame, source_verified: Column | None = None, technical_verified: Column | None = None) -> DataFrame:
    """``df`` with the roll-up of ``checks``: one status for each category and the suitability."""

    def status(category: str, verified: Column | None) -> Column:
        mine = F.filter("checks", lambda x: x["category"] == category)
        return F.when(F.exists(mine, lambda x: x["severity"] == "critical"), "fail").when(F.size(mine) > 0, "review_required").when(verified if verified is not None else F.lit(False), "verified").otherwise("unverified")

    d = df.withColumn(FIDELITY, status(FIDELITY, source_verified)).withColumn(TECHNICAL, status(TECHNICAL, technical_verified))
    clean = (F.col(FIDELITY) == "verified") & (F.col(TECHNICAL) == "verified") & (F.size("checks") == 0)
    return d.withColumn(SUITABILITY, F.when(F.exists("checks", lambda x: x["severity"] == "critical"), "exclude").when(clean, "eligible").otherwise("review_required"))


def metrics(c: Column) -> list[Column]:
    """Characters, visible characters, lines, words and math lines of a text."""
    return [
        F.length(c).cast("long").alias("characters"),
        F.length(F.regexp_replace(c, r"\s", "")).cast("long").alias("visible"),
        F.size(lines(c)).cast("long").alias("lines"),
        F.regexp_count(c, F.lit(r"\S+")).cast("long").alias("words"),
        F.size(math_lines(c)).cast("long").alias("math_lines"),
    ]


def evidence(df: DataFrame, key: str, text: str = "text", most: int = 30) -> DataFrame:
    """``(key, code, count, line_numbers)`` of the detectors by line: sorted line numbers, at most ``most``, no text."""
    t = F.coalesce(F.col(text), F.lit(""))

    def rows(p: str, math: bool) -> Column:
        hit = lambda x: x.rlike(p) & x.rlike(MATH_LINE) if math else x.rlike(p)
        return F.array_compact(F.transform(lines(t), lambda x, i: F.when(hit(x), i + 1)))

    found = [(code, p, m) for code, _, _, p, m in LINE_PATTERNS + LOOKING_PATTERNS] + [(code, p, False) for code, _, _, p in PATTERNS if code != "AMBIGUOUS_HYPHENATION"]
    one = F.array(*[F.struct(F.lit(code).alias("code"), rows(p, m).alias("at")) for code, p, m in found])
    x = df.select(F.col(key).alias("key"), F.explode(one).alias("x")).filter(F.size("x.at") > 0)
    return x.select(F.col("key").alias(key), "x.code", F.size("x.at").cast("long").alias("count"), F.slice("x.at", 1, most).alias("line_numbers"))
