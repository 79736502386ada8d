"""Broken prompt and response pairs (problem 2)."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curata.functions import text as T
from curata.llm import cuts
from curata.llm.copies import _role
from curata.runtime import Stage, clean_id, lookup

ECHO = 0.85  # share of an answer's words that are the question's
REST = 30  # words that may stand around a refusal
SPIKE = 6.0  # a length limit: so many standard deviations more distinct answers of one length than its neighbours let expect

_THINK = re.compile(r"<think>.*?</think>", re.S | re.I)
_VALUE = re.compile(r"\s*(?:\W{0,4}\s*)?[-+−±~≈]?\d[\d.,'  ]*(?:e[-+]?\d+|[×x]\s?10\S*)?\s*[^\d\s]{0,8}(?:\s?[^\d\s]{1,8})?\s*$", re.I)
_CLOSED = re.compile(r"[.!?)\]}\"'`|»”“]\s*$")
_RESULT = re.compile(r"(?:=>|→|⇒)\s*[-+−]?\d[\d.,]*\s*\S{0,8}\s*$")
# Stand-ins for an answer, as letters and digits.
STAND_INS = set(
    """tbd tba tbc todo na none null nil nan undefined unknown empty blank pending noanswer noresponse noanswergiven answer answers response reply
    placeholder insertanswerhere answerhere youranswerhere leer keine keineantwort antwort ohneantwort vacío vacio ninguna ninguno sinrespuesta
    respuesta vide aucun aucune sansréponse pasderéponse réponse xxx assistant""".split()
)
# Sentences that decline, in English, German, Spanish and French (folded; straight or no apostrophes).
REFUSALS = [
    r"\b(?:i|we)\b.{0,24}\b(?:can ?not|can'?t|could not|won'?t|will not|(?:am|'m|are) (?:not able|unable|not allowed|not permitted)(?: to)?|may not)\b.{0,30}\b(?:help|assist|answer|answering|discuss|comply|provid\w+|respond|reply)\b",
    r"\b(?:i|we) (?:must|have to|need to|will have to|would rather) (?:pass|decline|refuse)\b",
    r"\b(?:something|request|question|topic) (?:i|we) (?:must|have to) (?:decline|refuse|pass)\b",
    r"\bgo(?:es)? against my (?:guidelines|policy|policies|principles|rules)\b",
    r"\boutside what (?:i|we) (?:may|can|am allowed to)\b",
    r"\bno answer will be (?:given|provided)\b",
    r"\b(?:kann|darf|möchte|werde|will) ich\b.{0,50}\b(?:nicht (?:helfen|beantworten|weiterhelfen|antworten)|keine (?:auskunft|antwort|hilfe))",
    r"\bich\b.{0,12}\b(?:kann|darf|möchte|werde)\b.{0,50}\b(?:nicht (?:helfen|beantworten|weiterhelfen|antworten)|keine (?:auskunft|antwort|hilfe))",
    r"\b(?:muss ich|ich muss)\b.{0,40}\b(?:ablehnen|passen)",
    r"\b(?:wird|gebe ich|ich gebe)\b.{0,30}\bkeine antwort\b",
    r"\bno (?:puedo|podré|podemos|me es posible|me está permitido|estoy en condiciones de)\b.{0,20}\b(?:ayudar|responder|contestar|atender)",
    r"\bno (?:daré|voy a dar|responderé|contestaré)\b",
    r"\b(?:debo|tengo que) (?:rechazar|declinar)\b",
    r"\bje ne (?:peux|puis|pourrai|suis)\b.{0,24}\b(?:aider|répondre|donner|mesure)",
    r"\bje (?:dois|préfère) (?:décliner|refuser)\b",
    r"\bje ne (?:donnerai|fournirai|répondrai)\b",
    r"\bil ne m'?est pas (?:possible|permis)\b",
]
_REFUSAL = re.compile("|".join(REFUSALS))
# Every one of the patterns needs one of these words.
REFUSAL_WORDS = set(
    """help assist answer answering discuss comply provide provides provided providing respond reply pass decline refuse guidelines policy policies
    principles rules outside given helfen beantworten weiterhelfen antworten auskunft antwort hilfe ablehnen passen ayudar responder contestar
    atender daré voy responderé contestaré rechazar declinar aider répondre donner mesure décliner refuser donnerai fournirai répondrai possible permis""".split()
)
# Words of one of the four languages only.
LANGUAGE_WORDS = {
    "en": "the of and to is with that this are it by from should must if which what when how does be has have you your not only before while because into at for will would can where there than then each who they we our explain please write".split(),
    "de": "der das und ist nicht dem den mit von zu auf bei ein eine einen einer eines einem für wird sich im am nach über oder aber wenn dass als warum wie kann soll zeigt sie wir bitte keine hier liegt auch zum zur vom sind wurde obwohl weil sofern etwa aus ich ursache".split(),
    "es": "el los las una por con del al más para y es fue qué cómo como pero puede cuando cada tras según luego porque aunque sin cerca lo debo hay este esta nota nuestro sus siempre quedó desde hasta muy sobre solo donde".split(),
    "fr": "le les des et une dans pour du au avec est pas qui ne il elle nous vous sont été était mais par ce cette car lorsque puisque alors faut peut bien aux d l qu n s ensuite environ pourquoi comment que-dois où sans ici essai on".split(),
}
# Words of further languages that none of the four has.
LANGUAGE_WORDS |= {
    "it": "il lo gli di della dello delle degli dei nel nella non che è sono questo questa anche più perché dopo prima quindi essere viene può dal dalla alla allo".split(),
    "nl": "het een van niet dat voor met zijn wordt ook naar bij uit maar dit deze moet zodat omdat eerst dan worden kan wel geen".split(),
    "pt": "não uma os em mais são você isso quando também pela pelo ao às foi deve antes depois então porque muito seu".split(),
}
# Scripts of other languages than those of Latin letters.
_SCRIPTS = {"ru": "\u0400-\u04ff", "el": "\u0370-\u03ff", "ar": "\u0600-\u06ff", "he": "\u0590-\u05ff", "hi": "\u0900-\u097f", "th": "\u0e00-\u0e7f", "ko": "\uac00-\ud7af", "ja": "\u3040-\u30ff", "zh": "\u3400-\u9fff"}
_OTHER_SCRIPT = re.compile("[" + "".join(_SCRIPTS.values()) + "]")
_SCRIPT_OF = {k: re.compile(f"[{v}]") for k, v in _SCRIPTS.items()}
UNKNOWN_WORDS, UNKNOWN_SHARE = 12, 0.03  # so many distinct words, less than that share of them of any known language: another one
_LETTERS = {"ß": "de", "ä": "de", "ö": "de", "ü": "de", "ñ": "es", "¿": "es", "¡": "es", "ó": "es", "í": "es", "ú": "es", "ê": "fr", "è": "fr", "ç": "fr", "à": "fr", "œ": "fr", "ù": "fr", "î": "fr", "ô": "fr"}
_SHARED_WORDS = {w for w, n in Counter(w for ws in LANGUAGE_WORDS.values() for w in set(ws)).items() if n > 1}
_WORD_OF = {w: k for k, ws in LANGUAGE_WORDS.items() for w in ws if w not in _SHARED_WORDS}
_ALPHA = re.compile(r"[^\W\d_]+")
# How a language is asked for in the four languages.
ASKED = {
    "en": re.compile(r"\b(?:in|into|to)\s+english\b|\b(?:auf|ins|in)\s+englisch|\b(?:en|al)\s+inglés|\ben\s+anglais"),
    "de": re.compile(r"\b(?:in|into|to)\s+german\b|\b(?:auf|ins|in)\s+deutsch|\b(?:en|al)\s+alemán|\ben\s+allemand"),
    "es": re.compile(r"\b(?:in|into|to)\s+spanish\b|\b(?:auf|ins|in)\s+spanisch|\b(?:en|al)\s+(?:español|castellano)|\ben\s+espagnol"),
    "fr": re.compile(r"\b(?:in|into|to)\s+french\b|\b(?:auf|ins|in)\s+französisch|\b(?:en|al)\s+francés|\ben\s+français"),
}


def language(ws: list[str]) -> str | None:
    """Language by words of one language only, or by script; ``other`` for Latin text without such words; None if too few or mixed."""
    c: Counter[str] = Counter([_WORD_OF[w] for w in ws if w in _WORD_OF])
    letters = foreign = 0
    for w in ws:
        if not w.isascii():
            for ch in w:
                if ch in _LETTERS:
                    c[_LETTERS[ch]] += 0.5
            foreign += len(_OTHER_SCRIPT.findall(w))
        letters += len(w)
    if foreign > 3 and foreign * 2 > letters:
        text = "".join(ws)
        return max(_SCRIPT_OF, key=lambda k: len(_SCRIPT_OF[k].findall(text)) * (3 if k == "ja" else 1))
    top = c.most_common(2)
    plain_ = {w for w in ws if w.isalpha() and len(w) > 1}
    if len(plain_) >= UNKNOWN_WORDS and sum(w in _WORD_OF or w in _SHARED_WORDS for w in plain_) < UNKNOWN_SHARE * len(plain_):
        return "other"
    if not top or top[0][1] < 2 or (len(top) > 1 and top[1][1] * 2 > top[0][1]):
        return None
    return top[0][0]


def plain(s: str) -> tuple[str, dict | None]:
    """The answer's own text: without thoughts, and of a JSON object its ``response``."""
    t = (_THINK.sub("", s) if "<" in s else s).strip()
    v = T.json_object(t)
    if v is None:
        return t, None
    said = v.get("response", v.get("answer", v.get("content")))
    return (said if isinstance(said, str) else ""), v


def is_empty(ws: list[str], obj: dict | None) -> bool:
    if obj is not None:
        return not any(T.letters(x) not in STAND_INS | {""} if isinstance(x, str) else x not in (None, [], {}) for k, x in obj.items() if k not in ("status", "id"))
    return not ws or (len(ws) < 6 and "".join(ws) in STAND_INS)


def is_refusal(t: str) -> bool:
    f = T.fold(t).replace("’", "'").replace("‘", "'").replace(" ", " ")
    f = re.sub(r"\s+", " ", f)
    hits = list(_REFUSAL.finditer(f))
    if not hits:
        return False
    start, end = hits[0].start(), hits[-1].end()
    before = max(f.rfind(x, 0, start) for x in (". ", "! ", "? ")) + 1
    after = min([k for k in (f.find(x, end) for x in (".", "!", "?")) if k >= 0] or [len(f)])
    return len(_ALPHA.findall(f[:before])) + len(_ALPHA.findall(f[after:])) <= REST and not re.search(r"\d", f[after:])


def is_echo(b: list[str], a: list[str]) -> bool:
    """Whether an answer's words ``a`` are nothing but the question's words ``b`` again, once or several times."""
    if len(a) < 5 or len(a) * 2 < len(b):
        return False
    known = set(b)
    if sum(w in known for w in a) >= ECHO * len(a):
        times = max(1, round(len(a) / len(b)))
        have = Counter({w: n * times for w, n in Counter(b).items()})
        if sum((Counter(a) & have).values()) >= ECHO * len(a):
            return True
    y = "".join(b)
    if len(y) <= 20:
        return False
    x = "".join(a)
    return y in x and len(x.replace(y, "")) <= len(y) * 0.15


# How answers decline and how they don't, the first examples of the classifier.
DECLINING = """I cannot help with that. I'm sorry, but I can't assist with this request. I am unable to answer this question. I must decline to answer. Sorry, I won't discuss this topic.
I am not able to comply with this. That is not something I am comfortable with. I would rather not talk about this subject. It would go against my guidelines to answer.
As an assistant I am not allowed to respond. Unfortunately this is outside what I may do.
Leider kann ich dabei nicht helfen. Das kann ich nicht beantworten. Es tut mir leid, dazu darf ich keine Auskunft geben. Ich muss diese Anfrage ablehnen. Das möchte ich lieber nicht erläutern. Darüber spreche ich nicht.
Lo siento, no puedo ayudar con eso. No me es posible responder a esta pregunta. Debo rechazar esta petición. Prefiero no hablar de este tema. Lamento no poder atender su solicitud.
Désolé, je ne peux pas vous aider. Il m'est impossible de répondre à cette demande. Je dois décliner cette requête. Je préfère ne pas aborder ce sujet. Je ne suis pas en mesure de répondre."""
SOUND = """Check the valve first, because the seal wears out before the motor does. You can do this with the tool that is in the case. I would start with a new reading and then go on to the next step. That is not the cause.
It is important to note that this must not be more than the limit. As you can see, there is no leak, so we are able to answer that it will hold. The request was declined by the controller. This is not a fault of the part.
Prüfen Sie zuerst das Ventil, weil die Dichtung vor dem Motor verschleißt. Das ist nicht die Ursache. Ich würde es so lassen, da sich der Wert kaum ändert. Dazu kann man die Anzeige nutzen. Es muss noch einmal gemessen werden.
Compruebe primero la válvula, porque no se puede medir con el motor en marcha. El valor de este ensayo no es el que se esperaba. Con eso es posible seguir. Debo decir que me parece bien.
Vérifiez d'abord la soupape, car il est impossible de mesurer ce débit. Ce n'est pas la pompe mais le moteur. Je ne vois pas de fuite dans la conduite. Il faut que vous notiez la valeur."""
SAMPLE = 20_000  # about so many turns are drawn, by their hash; the classifier is fitted on the answers among them
ODDS = 2.0  # mean log odds of the words of a declining sentence


def _sentences(t: str) -> list[str]:
    return [x for x in re.split(r"(?<=[.!?。])\s+|\n+", t) if x.strip()]


def _plain_words(t: str) -> list[str]:
    return _ALPHA.findall(T.fold(t))


def decline_model(sample: list[str]) -> dict[str, float]:
    """Log odds of each word that it stands in a sentence that declines, fitted on ``sample`` (answers).

    Sentences that match a fixed pattern count as declining, those of answers
    without such a sentence as sound; a few fixed examples of both come first.
    """
    yes, no = Counter(), Counter()
    n_yes = n_no = 0
    for t in _sentences(DECLINING):
        n_yes += 1
        yes.update(set(_plain_words(t)))
    for t in _sentences(SOUND):
        n_no += 1
        no.update(set(_plain_words(t)))
    for t in sample:
        parts = _sentences(t)
        if is_refusal(t):
            for x in parts:
                if _REFUSAL.search(re.sub(r"\s+", " ", T.fold(x).replace("’", "'").replace("‘", "'"))):
                    n_yes += 1
                    yes.update(set(_plain_words(x)))
        else:
            for x in parts:
                n_no += 1
                no.update(set(_plain_words(x)))
    odds = lambda w: math.log((yes[w] + 0.1) / (n_yes + 0.2)) - math.log((no[w] + 0.1) / (n_no + 0.2))
    return {w: odds(w) for w in yes | no}


def declines(t: str, model: dict[str, float]) -> bool:
    """Whether an answer has a sentence that declines, by ``model``, and little else: no more than ``REST`` other words, no number after it."""
    rest, hit = 0, False
    for x in _sentences(t):
        w = _plain_words(x)
        known = set(w)
        if len(w) >= 3 and sum(model.get(k, 0.0) for k in known) >= ODDS * len(known):
            hit = True
        else:
            rest += len(w)
            if rest > REST or (hit and re.search(r"\d", x)):
                return False
    return hit


def is_cut(t: str) -> bool:
    if t[:1] == "{" and t[-1:] != "}":
        return True
    if _VALUE.match(t) or _RESULT.search(t, max(0, len(t) - 60)):
        return False
    return cuts.stop_kind(t) is not None


def _judge(batches, model: dict[str, float] | None = None):
    model = decline_model([]) if model is None else model
    strong = {w for w, x in model.items() if x >= ODDS}
    names = ["id", "turn", "defect", "form", "cut", "length", "open"]
    for b in batches:
        out: dict[str, list] = {k: [] for k in names}
        for rid, turns in zip(b.column("id").to_pylist(), b.column("t").to_pylist()):
            asked, wq = [], None
            for x in turns:
                s = x["content"] or ""
                if x["role"] == "user":
                    wq = T.words(s)
                    asked.append(s)
                    lq = language(wq)
                if x["role"] != "assistant" or x["calls"] or wq is None:
                    continue
                t, obj = plain(s)
                wt = T.words(t)
                defect = None
                cut = False
                if is_empty(wt, obj):
                    defect = "empty"
                elif (not REFUSAL_WORDS.isdisjoint(wt) and is_refusal(t)) or (not strong.isdisjoint(wt) and declines(t, model)):
                    defect = "refusal"
                elif is_echo(wq, wt):
                    defect = "echo"
                else:
                    la = language(wt)
                    if la and lq and la != lq and not (la in ASKED and ASKED[la].search(T.fold("\n".join(asked)))):
                        defect = "other_language"
                    else:
                        cut = obj is None and is_cut(t)
                text = defect is None and obj is None
                out["id"].append(rid)
                out["turn"].append(x["turn"])
                out["defect"].append(defect)
                out["form"].append(" ".join(wt) if text else None)
                out["cut"].append(cut)
                out["length"].append(len(s))
                out["open"].append(text and not _CLOSED.search(t, max(0, len(t) - 4)) and not _RESULT.search(t, max(0, len(t) - 60)) and not _VALUE.match(t))
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("id", pa.string()), ("turn", pa.int32()), ("defect", pa.string()), ("form", pa.string()), ("cut", pa.bool_()), ("length", pa.int32()), ("open", pa.bool_())]))


def answers(messages: DataFrame) -> DataFrame:
    """One judged row for each assistant turn without tool calls that follows a user turn of its record.

    The question is the last user turn before it. Null contents are empty, roles
    are read trimmed in lower case, repeated rows count once, null ids are left out.
    """
    calls = F.coalesce(F.length(F.regexp_replace("tool_calls", r"[\s\[\]{}]|null", "")) > 0, F.lit(False))
    m = messages.select(clean_id(F.col("id")).alias("id"), F.col("turn").cast("int").alias("turn"), _role(F.col("role")).alias("role"), "content", calls.alias("calls"))
    m = m.filter("id is not null and turn is not null and role in ('user', 'assistant')")
    turns = m.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "content", "calls"))).alias("t"))
    # the classifier's sample: rows by their hash, about SAMPLE of them whatever the table, never more than twice that
    said = m.filter("role = 'assistant' and not calls and content is not null")
    share = min(1.0, SAMPLE / max(1, messages.count()))
    picked = said.filter(F.pmod(F.xxhash64("id", "turn", "content"), F.lit(1 << 30)) < int(share * (1 << 30))).select("content").limit(2 * SAMPLE)
    sample = [plain(r.content)[0] for r in picked.collect()]
    model = m.sparkSession.sparkContext.broadcast(decline_model(sample))
    return turns.mapInArrow(lambda batches: _judge(batches, model.value), "id string, turn int, defect string, form string, cut boolean, length int, open boolean")


def defects(messages: DataFrame) -> DataFrame:
    """``(id, turn, defect)`` of the defective answers.

    In this order an answer is ``empty``, ``refusal``, ``echo``,
    ``other_language`` or ``truncated``. Answers without another defect are
    sorted by text (their words) and compared with their neighbours: an answer
    that a longer one goes on with inside a word is truncated
    (:func:`curata.llm.cuts.cut_copies`), one that is equal to an answer with a
    complete end is not, whatever has become of its own punctuation. Answers of a
    length at which limits cut (more distinct answers than the lengths around it
    let expect, most of them open) are truncated if their end is open. For the
    rest the end decides.
    """
    a = Stage(answers(messages), "answers")
    keyed = a.df.withColumn("key", F.md5("form"))
    forms = keyed.filter("form is not null").groupBy("key").agg(F.min("cut").alias("cut_all"), F.min("form").alias("base"), F.min("length").alias("length"), F.max("open").alias("open"))
    forms = Stage(forms, "forms")
    flags = cuts.flagged(forms.df.select("key", "cut_all"), cuts.cut_copies(forms.df.select("base")))
    # one row for each length; the window runs over that table, not over the answers
    n = forms.df.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("open").cast("long")).alias("n_open"))
    n = n.withColumn("band", F.floor(F.col("length") / 4096))
    w = Window.partitionBy("band").orderBy("length").rangeBetween(-10, 10)
    n = n.withColumn("others", (F.sum("n").over(w) - F.col("n")) / 20.0)
    spikes = n.filter((F.col("n") - F.col("others") >= SPIKE * F.sqrt(F.col("others") + 1)) & (F.col("n_open") * 2 >= F.col("n"))).select("length", F.lit(True).alias("limit"))
    done = keyed.filter("defect is not null").select("id", "turn", "defect")
    rest = keyed.filter("defect is null").select("id", "turn", "key", "cut", "length", "open")
    judged = lookup(rest, flags, "key", "left", rows=a.rows).join(spikes, "length", "left")
    hit = (F.col("cut") & F.coalesce("cut_all", F.lit(True))) | (F.col("how").isNotNull() & F.col("open")) | (F.coalesce("limit", F.lit(False)) & F.col("open"))
    return done.union(judged.filter(hit).select("id", "turn", F.lit("truncated").alias("defect")))
