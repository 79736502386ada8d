"""Where a text stops: complete endings against cut ones, and shorter copies (problems 2 and 9)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curata.functions import text as T
from curata.runtime import FEW, Stage, lookup

CHANCE = 8  # words that two texts don't begin with alike by chance
SENT = FEW  # digests that are sent everywhere

# Marks that are put where a text was cut.
MARKS = re.compile(r"(?:…|\.\.\.|\[(?:\.\.\.|…)\]|\((?:\.\.\.|…|more|cont(?:inued|\.)?|weiter|suite|sigue)\)|\[(?:more|truncated|cut|gekürzt|tronqué|truncado)\]|<(?:truncated|cut|more)>|-{2,}\s*(?:more|cut here)\s*-{2,}|(?:read|see) more)\s*$", re.I)
_TAIL = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF, 0]))  # white space, joiners and NUL
_MARK_ROOM = 48  # no mark is longer
_BRACKET = re.compile(r'[()\[\]{}“”«»„"]')
_ENTITY = re.compile(r"&(?:#x?[0-9a-fA-F]{0,6}|[A-Za-z]{1,7})$")
_ESCAPE = re.compile(r"(?:\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|%[0-9A-F]?)$")
_FENCE = re.compile(r"^\s*(```+|~~~+)", re.M)
_ITEM = re.compile(r"^\s*(?:[-*•+‣]|\d{1,3}[.)])\s+")
_SIGN = re.compile(r"^\s*(?:--|—|–)\s*\S")
_KEYS = re.compile(r"^\s*(?:keywords?|key words|tags?|schlagwörter|schlagworte|stichworte|stichwörter|mots[- ]clés|palabras clave|topics?|themen)\s*[:：]", re.I)
_FORMULA = re.compile(r"^\s*[^\s=.!?]{1,12}(?:\s*\([^()]*\))?\s*=\s*\S")
_RESULT = re.compile(r"=>?\s*[-+−±]?\d[\d.,]*\s*[^\d\s]{0,8}$")
_HEAD = re.compile(r"^\s*#{1,6}\s+\S")
_END = re.compile(r"[.!?。！？][\"'”’»)\]}*_`]*$")
_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
# Words after which no sentence, list item or line ends, in English, German, Spanish and French.
DANGLING = set(
    """a an the and or but of to in on at by for with from into near than that which whose if when while because although
    is was were are be been must should will would can could not no nor as so then its their this these those every each over under
    per between before after during until unless whether
    der die das den dem des ein eine einen einem einer eines und oder aber von zu im in an auf bei für mit aus nach vor
    dass wenn weil da obwohl während sofern ist war sind wird werden nicht sich zur zum vom am beim als wie über unter zwischen
    el la los las un una unos unas y o pero de del al en con por para desde hasta que si cuando porque aunque mientras
    es son fue no se su sus entre sobre sin como más menos tras
    le les du des et ou mais à au aux dans sur avec pour par depuis jusque que qui quand lorsque parce car bien alors
    est sont était ne pas se sa ses leur leurs entre sous sans comme plus moins après avant cette ces""".split()
)

# Those of them that end no sentence without its punctuation either ("sets in", "fällt aus" do).
_NEVER_LAST = set("the an and or of than which whose if because although der den dem des ein eine einen einem einer eines und oder dass weil obwohl el los las unos unas del porque aunque les du et ou parce".split())


def bare(s: str) -> str:
    """The text without white space and marks at its end."""
    s = s.rstrip(_TAIL)
    m = MARKS.search(s, max(0, len(s) - _MARK_ROOM))
    return s[: m.start()].rstrip(_TAIL) if m else s


def _open(line: str) -> bool:
    """Whether a bracket or quote that begins in ``line`` is still open at its end."""
    stack: list[str] = []
    low = False
    for c in _BRACKET.findall(line):
        if c in "([{“«":
            stack.append(c)
        elif c == "„":
            low = True
        elif c in _PAIRS:
            if c == "”" and low:
                low = False
            elif stack and stack[-1] == _PAIRS[c]:
                stack.pop()
        if c == "“" and low:
            stack.pop()
            low = False
    return bool(stack) or low or line.count('"') % 2 == 1


def _punctuated(s: str) -> bool:
    """Whether the text has punctuation, commas and colons included (copies with it taken out keep a mark after a label or number at most)."""
    ws = len(re.findall(r"\S+", s))
    return ws < 12 or len(re.findall(r"[.,;:!?。！？](?=\s|$)", s)) * 40 >= ws


def stop_kind(s: str | None, punctuated: bool | None = None) -> str | None:
    """Why a text counts as cut at its end, from the text alone; None if it may be complete.

    ``mark``, ``bytes`` (half a character, entity or escape), ``code``, ``row``,
    ``open`` (bracket or quote), ``sentence`` or ``line``. The empty text, and
    one of white space, is not cut.
    """
    if not s:
        return None
    t = s.rstrip(_TAIL)
    if not t:
        return None
    if t[-1] == "�" or _ENTITY.search(t, max(0, len(t) - 12)) or _ESCAPE.search(t, max(0, len(t) - 12)):
        return "bytes"
    if ("```" in t or "~~~" in t) and len(_FENCE.findall(t)) % 2:
        return "code"
    if MARKS.search(t, max(0, len(t) - _MARK_ROOM)):
        return "mark"
    lines = t.split("\n")
    last = lines[-1]
    if _FENCE.match(last):
        return None
    if last.lstrip().startswith("|"):
        if not last.rstrip().endswith("|"):
            return "row"
        above = next((x for x in reversed(lines[:-1]) if x.strip()), "")
        return "row" if above.lstrip().startswith("|") and above.count("|") > last.count("|") else None
    if _open(last):
        return "open"
    if _END.search(last):
        return None
    word = re.findall(r"[^\W\d_]+", last)
    if _SIGN.match(last) and len(lines) > 1:
        return None
    if last[-1] in ",;:=×+−/(&" or (last[-1] == "-" and not last.endswith("--")):
        return "line" if _KEYS.match(last) or _FORMULA.match(last) or _ITEM.match(last) else "sentence"
    if _KEYS.match(last) or _HEAD.match(last):
        return None
    if _ITEM.match(last):
        return "line" if word and last.endswith(word[-1]) and word[-1].lower() in DANGLING else None
    if _FORMULA.match(last) or _RESULT.search(last):
        return None
    if last[-1] in ")]}\"”»'’`*_>|":
        return None
    if len(lines) > 1 and not lines[-2].strip() and len(last.split()) <= 8 and not re.search(r"[a-zäöüß]{2,} [a-zäöüß]{2,} [a-zäöüß]{2,}", last):
        return None if re.search(r"\d", last) and len(last.split()) <= 3 else "sentence"
    if word and last.endswith(word[-1]) and word[-1].lower() in _NEVER_LAST:
        return "sentence"
    if not (_punctuated(t) if punctuated is None else punctuated):
        return None
    return "sentence"


def _neighbours(batches):
    """Over rows sorted by text: each distinct text that the next one goes on with, and how; the first and last of all come as well."""
    last = None
    first = True

    def row(text, nxt, edge):
        return {"base": text, "more": nxt[len(text) : len(text) + 40] if nxt is not None and text and nxt.startswith(text) else None, "edge": edge}

    def batch(rows):
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("base", pa.string()), ("more", pa.string()), ("edge", pa.string())]))

    for b in batches:
        out = []
        for s in b.column("base").to_pylist():
            if s == last:
                continue
            if last is not None:
                x = row(last, s, "first" if first else None)
                if x["more"] is not None or first:
                    out.append(x)
                first = False
            last = s
        if out:
            yield batch(out)
    if last is not None:
        yield batch([row(last, None, "both" if first else "last")])


def shorter_copies(texts: DataFrame, parts: int | None = None, distinct: bool = False) -> DataFrame:
    """``(base, more)``: distinct texts that are strict prefixes of a longer one, and how that goes on.

    A self-join by prefix: texts are range-partitioned and sorted, so that all
    that begin with a text follow it at once, and each is compared with its next
    neighbour. The neighbours on the two sides of a boundary between partitions
    meet in a second, small join of one row each. Equal texts count once, so a
    text that a third of the rows have costs no more than one; null and empty
    texts are left out. ``distinct`` says that there are no such texts and no
    repeated ones.
    """
    d = texts.select("base") if distinct else texts.select("base").filter("base is not null and base <> ''").distinct()
    s = d.repartitionByRange(parts, "base") if parts else d.repartitionByRange("base")
    s = s.sortWithinPartitions("base")
    near = Stage(s.mapInArrow(_neighbours, "base string, more string, edge string").withColumn("part", F.spark_partition_id()), "neighbours")
    # one first and one last row for each partition
    w = Window.orderBy("part")
    firsts = near.df.filter("edge in ('first', 'both')").select("part", F.col("base").alias("head"))
    nxt = firsts.select((F.dense_rank().over(w) - 1).alias("k"), "head")
    lasts = near.df.filter("edge in ('last', 'both')").select(F.dense_rank().over(w).alias("k"), "base")
    over = lasts.join(nxt, "k").filter("startswith(head, base)").select("base", F.expr("substring(head, length(base) + 1, 40)").alias("more"))
    return near.df.filter("more is not null").select("base", "more").union(over)


def cut_copies(texts: DataFrame, parts: int | None = None) -> Stage:
    """``(key, how)``: md5 of the texts of ``texts(base)`` that a longer one goes on with; texts are words between single spaces.

    ``how`` is ``word`` if the longer text (:func:`shorter_copies`) goes on inside
    the last word, and no text has that word as a whole, followed by another:
    such a text is cut. It is ``text`` if a longer one goes on with the next word
    and the text has ``CHANCE`` words or more, as shorter ones begin alike by
    chance: such a text is cut unless its own end is a complete one.
    """
    distinct = Stage(texts.select("base").filter("base is not null and base <> ''").distinct(), "texts")
    short = shorter_copies(distinct.df, parts, True).select("base", (~F.startswith("more", F.lit(" "))).alias("inside")).distinct()
    short = Stage(short, "short", inside=F.count_if("inside"))
    mid = short.df.filter("inside").select("base")
    if short.seen["inside"]:
        last = F.element_at(F.split("base", " "), -1)
        ends = mid.select(last.alias("word")).distinct()
        # whole words: those that another follows; only the few that are asked for are kept
        words = distinct.df.select(F.split("base", " ").alias("w")).select(F.explode(F.array_distinct(F.slice("w", F.lit(1), F.size("w") - 1))).alias("word"))
        whole = words.join(ends, "word", "left_semi").distinct().withColumn("whole", F.lit(True))
        mid = mid.withColumn("word", last).join(whole, "word", "left").filter("whole is null").select("base")
    next_ = short.df.filter(~F.col("inside") & (F.size(F.split("base", " ")) >= CHANCE)).select("base")
    how = mid.withColumn("how", F.lit("word")).union(next_.withColumn("how", F.lit("text")))
    out = Stage(how.groupBy(F.md5("base").alias("key")).agg(F.max("how").alias("how")), "cut")
    for s in (distinct, short):
        s.drop()
    return out


def flagged(df: DataFrame, keys: Stage) -> DataFrame:
    """``df`` with ``how`` of its ``key``, null where there is none; a short list is sent everywhere, a long one joined hot keys apart."""
    if not keys.rows:
        return df.withColumn("how", F.lit(None).cast("string"))
    return df.join(F.broadcast(keys.df), "key", "left") if keys.rows <= SENT else lookup(df, keys.df, "key", "left")


def _folded(batches):
    for b in batches:
        got = [None if s is None else " ".join(T.words(bare(s))) for s in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(got, pa.string())], ["doc_id", "text", "base"])


def _complete(s: str) -> bool:
    """Whether a text ends as complete ones do: a sentence, or a line that needs no mark."""
    t = bare(s)
    last = t.split("\n")[-1]
    return bool(_END.search(t) or any(x.match(last) for x in (_ITEM, _KEYS, _HEAD, _FORMULA, _SIGN, _FENCE)) or _RESULT.search(last) or last.rstrip().endswith("|"))


def _kinds(batches):
    for b in batches:
        got = []
        for t, how in zip(b.column("text").to_pylist(), b.column("how").to_pylist()):
            got.append("shorter copy" if how == "word" or (how == "text" and not _complete(t)) else stop_kind(t))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.string())], ["doc_id", "kind"])


def cut_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, kind)`` of the documents whose text was cut off.

    A text counts as cut if a longer one elsewhere goes on inside the word or
    sentence in which it stops (:func:`cut_copies`, over the words of the folded
    texts without a mark at their end, so that copies in another case, spacing or
    punctuation count), or if its own end shows it (:func:`stop_kind`).
    Complete lists, tables, formulas, code, signatures and keyword lines are
    whole whatever their last character. Null and blank texts are not cut. Whole
    texts are compared; repeated rows count once.
    """
    d = docs.select("doc_id", "text").filter("doc_id is not null").mapInArrow(_folded, "doc_id long, text string, base string").withColumn("key", F.md5("base"))
    return flagged(d, cut_copies(d.select("base"))).select("doc_id", "text", "how").mapInArrow(_kinds, "doc_id long, kind string").filter("kind is not null").distinct()


def cut_rates(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """``(source, n_documents, n_cut, share)``: how often each source cuts its texts; sources trimmed, in lower case."""
    src = F.lower(F.trim(F.col("source"))).alias("source")
    d = docs.select("doc_id", src).filter("doc_id is not null").distinct().join(cut.select("doc_id", F.lit(1).alias("hit")).distinct(), "doc_id", "left")
    out = d.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count("hit").alias("n_cut"))
    return out.withColumn("share", F.round(F.col("n_cut") / F.col("n_documents"), 6))
