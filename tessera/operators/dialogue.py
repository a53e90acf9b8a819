"""Follow-up questions: what pronouns mean, and which topic goes on. Each turn sees a bounded window of the turns before it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRONOUNS = re.compile(r"\b(it|its|this|that|they|them|their|these|those|the company|the document)\b", re.IGNORECASE)
POINTED = re.compile(r"([그이]\s*(?:회사|제품|서비스|사람|문서|곳))")
PRONOUNS_KO = re.compile("(그것|이것|저것|거기|여기|그들|그녀|그의|이런|그런)")
KINDS = {"회사": "company", "제품": "product", "서비스": "service", "사람": "person", "문서": "document", "곳": "place"}
_BOLD = re.compile(r"\*\*([^*]{2,30})\*\*")
_NO_NAME = re.compile("^(신뢰도|답변|결론|요약|참고|출처|Confidence)")
_BEFORE_PAREN = re.compile(r"([\w가-힣]{2,20})\s*\([A-Za-z\s.]+\)")
_ABOUT = re.compile(r"(?:about|regarding|of)\s+(\w[\w\s.#+]*\w)")
_TOPIC_KO = re.compile(r"([\w가-힣]{2,20})(?:에\s*대해|을\s*|를\s*|이란|이라는)")
CHANGES = ("다른", "새로운", "그런데", "참고로", "그건 그렇고", "한편", "별도로", "다시", "바꿔서", "전환")
GENERAL = ("경쟁사", "경쟁", "시장", "업계", "산업", "전체", "비교", "모든", "누구", "어디", "회사들")


def kind_of(name: str, known: dict[str, str]) -> str:
    return known.get(name) or ("company" if any(x in name for x in ("회사", "은행", "법인", "그룹")) else "concept")


def memory(history: list[tuple[str, str]], known: dict[str, str]) -> list[tuple[str, str]]:
    """(name, kind) of what was talked about, latest turn first; history: (role, text) in order; known: name -> kind.

    From answers: bold names, and names before a bracket; from questions: known names (in their order), what follows "about", and Korean objects.
    """
    out: dict[str, str] = {}
    for role, text in reversed(history):
        text = (text or "").strip()
        if role == "assistant":
            names = [n for n in map(str.strip, _BOLD.findall(text)) if not _NO_NAME.match(n)] + _BEFORE_PAREN.findall(text)
        elif role == "user":
            names = [n for n in known if n in text]
            about = [re.split(r"\s+(?:and|or|is|are|was|were|in|on|for|with)\b", x.strip())[0].strip() for x in _ABOUT.findall(text)]
            names += [n for n in about if len(n) >= 2] + _TOPIC_KO.findall(text)
        else:
            continue
        for n in names:
            out.setdefault(n, kind_of(n, known))
    return list(out.items())


def resolved(query: str, history: list[tuple[str, str]], known: dict[str, str]) -> str:
    """The query with pronouns replaced: demonstratives by the latest of their kind, everything else by the latest of all."""
    if len(history) < 2 or not (PRONOUNS.search(query) or POINTED.search(query) or PRONOUNS_KO.search(query)):
        return query
    names = memory(history, known)
    if not names:
        return query
    out, latest = query, names[0][0]
    for phrase in POINTED.findall(query):
        kind = next(k for noun, k in KINDS.items() if noun in phrase)
        name = next((n for n, k in names if k == kind), None)
        if name:
            out = out.replace(phrase, name, 1)
    if out == query:
        out = POINTED.sub(lambda _: latest, out)
    out = PRONOUNS_KO.sub(lambda _: latest, out)
    return PRONOUNS.sub(lambda _: latest, out)


def rewritten(turns: DataFrame, known: dict[str, str], last: int = 10) -> DataFrame:
    """Turns (conv_id, turn, role, text) with `standalone`: user turns resolved by the `last` turns before; others as they are."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-last, -1)

    @F.pandas_udf("string")
    def resolve(role: pd.Series, text: pd.Series, history: pd.Series) -> pd.Series:
        return pd.Series([resolved(t, [(h["role"], h["text"]) for h in hs], known) if r == "user" and t else t for r, t, hs in zip(role, text, history)])

    held = turns.withColumn("history", F.collect_list(F.struct("role", "text")).over(before))
    return held.withColumn("standalone", resolve("role", "text", "history")).drop("history")


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def continued_topics(turns: DataFrame, known: list[str], last: int = 4, most: int = 80) -> DataFrame:
    """Turns with `topic` and `augmented`: a short question (`most` characters) that names no known entity, is not about the field at large
    and does not change the topic goes on with the entity last named in the `last` turns before; its name is put in front.

    The first two turns have no topic. "Back to X" is no change of topic.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    text = F.col("text")
    named = F.lit(None).cast("string")
    for n in reversed(known):
        named = F.when(text.contains(n), n).otherwise(named)
    returns = text.rlike(r"다시\s+[\p{L}\p{N}_]+\s*(?:얘기|이야기|관련|건)")
    rows = turns.withColumn("named", named).withColumn("place", F.row_number().over(w)).withColumn("recent", F.last("named", ignorenulls=True).over(w.rowsBetween(-last, -1)))
    goes_on = (F.col("role") == "user") & (F.col("place") > 2) & F.col("named").isNull() & (returns | ~_any(text, CHANGES)) & ~_any(text, GENERAL) & (F.length(text) <= most)
    topic = F.when(goes_on, F.col("recent"))
    return rows.withColumn("topic", topic).withColumn("augmented", F.concat_ws(" ", "topic", "text")).drop("named", "place", "recent")
