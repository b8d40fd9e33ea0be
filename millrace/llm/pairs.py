"""Defects of prompt and response pairs: empty, copy, refusal, language, truncated.

Distinct responses are range-partitioned and sorted by text; a response that is a proper beginning of its neighbour is
a shortened version of it (if any text begins with it, the next distinct one does). Between partitions only the first
and last response of each is exchanged. Lengths at which unfinished responses pile up, against the lengths around
them, are length limits. Both are evidence for every response of some length that has no end mark; endings that cannot
be meant (inside a sentence, an item, a row or a code block) are truncated in any case, which finds most of them, as a
truncated response need not have its full version in the data (see README). Rules for copies, refusals and language
come first; what the instruction asks for (repeating, translating, refusing, short answers) is no defect. The language
model is asked only where an answer has more common words of another language than of the question's, without which no
answer is judged to be in another language.

Defined cases: a null, blank or placeholder response is `empty`; a null instruction cannot be copied and has no
language; repeated rows give equal results; texts are compared whole; empty tables give empty results.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.languages import LanguageModel
from millrace.llm.textstats import common_words
from millrace.session import materialize

# What stands in place of an answer, without accents and punctuation.
PLACEHOLDERS = frozenset(
    [
        "na", "n a", "none", "null", "nil", "nan", "undefined", "vazio", "empty", "vacio", "vide", "todo", "tbd", "tba", "placeholder", "lorem ipsum", "pendente", "pending", "pendiente",
        "resposta", "answer", "response", "respuesta", "reponse", "output", "saida", "salida", "texto", "text", "content", "conteudo", "sem resposta", "no answer", "no response", "sin respuesta",
        "sem resposta disponivel", "nao informado", "nao informada", "nao se aplica", "nao disponivel", "not available", "not applicable", "no aplica", "no disponible", "sans reponse",
        "a preencher", "preencher", "preencher depois", "to be filled", "fill in", "por completar", "em branco", "blank", "in progress", "em breve", "coming soon", "insert answer here", "resposta aqui", "answer here",
        "your answer here", "escreva aqui", "inserir resposta", "inserir resposta aqui", "insira a resposta aqui", "insira aqui a resposta", "texto da resposta", "a definir", "aguardando resposta", "aguardando", "waiting for answer",
        "sem conteudo", "no content", "sin contenido", "error", "erro", "xxx", "xxxx", "s r", "sr", "nd", "n d", "nenhum", "nenhuma", "resposta pendente", "answer pending", "to do", "completar", "rellenar",
    ]
)
DANGLING = frozenset(
    """a o as os um uma uns umas de do da dos das em no na nos nas por pelo pela com sem sob para e ou que se mas ao aos à às como entre the an of in on at to for with without and or but that which by from as its
    el la los las un una del al y con sin por para que en le les des du et ou avec sans pour dans sur qui""".split()
)

# Words of refusals: an opening, what is refused, and what is offered instead.
REFUSAL = regex.compile(
    r"""(?ix)
    \b(?:nao|não)\s+(?:posso|consigo|poderei|vou|sou\s+capaz|estou\s+(?:autorizad[oa]|apt[oa])|será\s+possível|sera\s+possivel|é\s+possível|e\s+possivel|tenho\s+(?:permissão|permissao|como)|me\s+sinto\s+(?:confortável|confortavel|à\s+vontade)|me\s+é\s+permitido|o\s+farei|quero)\b
    |\b(?:i|we)\s*(?:\s+am|['’]m)?\s*(?:can(?:no|['’])t|can\s+not|cannot|won['’]?t|will\s+not|must\s+decline|prefer\s+not|would\s+rather\s+not|am\s+(?:unable|not\s+able|not\s+allowed|not\s+comfortable)|['’]?m\s+(?:unable|not\s+(?:able|allowed|comfortable|authori[sz]ed|permitted))|do\s+not\s+feel|don['’]t\s+feel|am\s+not\s+authori[sz]ed|have\s+to\s+decline|decline)\b
    |\bi['’]?m\s+(?:unable|not\s+(?:able|allowed|comfortable|authori[sz]ed|permitted))\b
    |\b(?:not\s+something\s+i|unable\s+to\s+(?:help|answer|assist)|not\s+(?:allowed|permitted|authori[sz]ed)\s+to|better\s+answer,?\s+because|leave\s+this\s+(?:one\s+)?(?:unanswered|without)|outside\s+(?:of\s+)?what\s+i|goes\s+against\s+my|beyond\s+what\s+i)\b
    |\bno\s+(?:puedo|podré|podre|voy\s+a|me\s+es\s+posible|será\s+posible|sera\s+posible|estoy\s+autorizad[oa]|me\s+siento)\b
    |\bje\s+ne\s+(?:peux|puis|suis\s+pas)\b|\bil\s+m['’]est\s+impossible\b
    |\b(?:prefiro|prefiero|preferi)\s+(?:não|nao|no)\b|\bvou\s+deixar\s+(?:essa|isso|esta)\b|\bmelhor\s+que\s+outra\s+pessoa\b|\bfoge\s+ao\s+que\b|\bfuera\s+de\s+lo\s+que\b|\bcontra\s+(?:as\s+)?minhas\s+diretrizes\b|\bagainst\s+my\s+guidelines\b|\bcontra\s+mis\s+directrices\b|\brecuso-me\b|\bdeclino\b
    |\b(?:não|nao)\s+(?:faço|faco|respondo|comento|opino|atendo|dá|da)\b|\b(?:rather|going|willing|able)\s+not\b|\bi['’]d\s+rather\s+not\b|\bnot\s+(?:going|willing)\s+to\b|\bno\s+comment\b|\bsem\s+coment[aá]rios\b|\bsin\s+comentarios\b
    |\b(?:recusad[ao]|bloquead[ao]|negad[ao]|rejeitad[ao]|rechazad[ao]|refused|declined|blocked|denied)\s+(?:pel[ao]s?|por|by|due|devido|per)\b|\b(?:tengo|tenho)\s+(?:permiso|permissão|permissao|autorización|autorizacion|autorização|autorizacao)\b|\b(?:política|politica)\s+de\s+(?:uso|conteúdo|contenido)\b|\b(?:usage|content)\s+policy\b|\bi\s+(?:refuse|decline)\b|\bme\s+niego\b
    """
)
OPENING = regex.compile(
    r"(?i)^\W*(?:desculpe|desculpa|sinto muito|infelizmente|lamento|peço desculpas|peco desculpas|perdão|agradeço|sorry|i['’ ]?a?m (?:really |very )?sorry|i am sorry|unfortunately|apologies|my apologies|i apologi[sz]e|as an ai|as a language model|como (?:um |uma )?(?:modelo|assistente|ia|inteligência)|como (?:un )?(?:modelo|asistente)|lo siento|lamentablemente|disculpa|desafortunadamente|désolée?|je suis désolée?|malheureusement|thank you|thanks|obrigad[oa]|i can(?:'|’|no)t|não posso|nao posso|no puedo|não vou|i won['’]t|i must|não consigo)"
)
ASKS_REFUSAL = regex.compile(r"(?i)\b(?:recus\w+|refus\w+|declin\w+|rechaz\w+|rejei\w+|reject\w*|negativa|desculpas|apolog\w+)\b")
ASKS_REPEAT = regex.compile(r"(?i)\b(?:repit\w+|repet\w+|repeat\w*|copi[ea]\w*|copy|transcrev\w+|transcrib\w+|reescrev\w+|reproduz\w*|reproduce|echo|exactly as|exatamente como|tal como está|répét\w+|recopi\w+)\b")
ASKS_LANGUAGE = regex.compile(
    r"(?i)\b(?:traduz\w*|tradu[çc]\w+|translat\w+|traduc\w+|traduis\w*|traduir\w*|(?:em|para o|para|into|to|in|al|en|au) (?:inglês|ingles|inglés|english|português|portugues|portugués|portuguese|espanhol|español|espanol|spanish|francês|frances|francés|french|anglais|portugais|espagnol))\b"
)
_FENCE = "```"
_ITEM = regex.compile(r"^\s*(?:[-*•·]|\d{1,3}[.)]|\(?[a-z]\))(?:\s+(?P<rest>.*))?$")
_END = regex.compile(r"[.!?][\"'”’»)\]*_]*$")
_CUT_DOTS = regex.compile(r"(?<=\w)(?:\.\.\.|…)$")
_SIGNED = regex.compile(r"@|\barroba\b|\(at\)|\[at\]|^\s*[\w\- ]{2,24}:\s|\d{3,}")


_BLANKS = regex.compile(r"</?[A-Za-z][^<>]*>|&(?:nbsp|ensp|emsp|zwnj|#160|#xa0);?")


_INNER_MARK = re.compile(r"[.!?](?=\s|$|[\"”])")
_CLOSED = re.compile(r"[”\"»]\s*$")
_BRACKETED = re.compile(r"\s*[\[<({]{1,2}[^\[\]<>(){}]{1,40}[\]>)}]{1,2}\s*")
_MARKS = regex.compile(r"\p{Mn}+")
_FOLDED = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")


@functools.lru_cache(16)
def fold_words(text: str) -> tuple[str, ...]:
    low = text.lower()
    return tuple(_FOLDED.findall(low if low.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", low))))


def is_empty(output: str | None) -> bool:
    if output is None:
        return True
    words = fold_words(_BLANKS.sub(" ", output))
    return not words or len(words) <= 5 and " ".join(words) in PLACEHOLDERS or len(words) <= 5 and _BRACKETED.fullmatch(output) is not None


def is_copy(instruction: str | None, given: str | None, output: str) -> bool:
    """The response is the question, once or more, perhaps with its input and a lead-in of a few words."""
    if not instruction or ASKS_REPEAT.search(instruction):
        return False
    asked, words = set(fold_words(instruction)), fold_words(output)
    if not asked or len(asked & set(words)) < 0.75 * len(asked):
        return False
    known = asked | set(fold_words(given or ""))
    return sum(w not in known for w in words) <= (4 + (len(words) > 40) if len(asked) >= 3 else 0)


def is_refusal(instruction: str | None, output: str) -> bool:
    """Short answers refuse by their words, longer ones by an opening too, long ones if half of their sentences do."""
    words = fold_words(output)
    if len(words) > 30 and not OPENING.match(output) or ASKS_REFUSAL.search(instruction or ""):
        return False
    if len(words) <= 60:
        return REFUSAL.search(output) is not None
    parts = [p for p in _SENTENCE.split(output) if p.strip()]
    return 2 * sum(REFUSAL.search(p) is not None or OPENING.match(p) is not None for p in parts) >= len(parts)


EVIDENCE_WORDS = 5
"""Neighbours and length limits say nothing about answers of fewer words, which begin many others by chance."""


def ending(output: str) -> str:
    """cut (cannot be meant), open (no end mark, but it could be meant) or complete."""
    end = _ending(output)
    return "open" if end == "complete" and not _END.search(output.rstrip()) and output.rstrip()[-1:] not in "|`”\"»" and len(fold_words(output)) >= EVIDENCE_WORDS else end


def _ending(output: str) -> str:
    text = output.rstrip()
    if text.count(_FENCE) % 2:
        return "cut"
    last = text.rsplit("\n", 1)[-1].strip()
    if text.endswith(_FENCE):
        return "complete"
    if last.startswith("|"):
        return "complete" if last.endswith("|") else "cut"
    item = _ITEM.match(last)
    if item:
        rest = (item["rest"] or "").strip()
        tail = fold_words(rest)
        return "cut" if not tail or rest[-1] in ",:;(-–" or tail[-1] in DANGLING and len(tail) > 1 else "complete" if not _END.search(rest) and len(tail) < 12 or _END.search(rest) else "open"
    if _CUT_DOTS.search(text):
        return "complete" if len(regex.findall(r"(?:\.\.\.|…)", text)) >= 3 else "cut"
    if _END.search(text) or _CLOSED.search(text) and _END.search(regex.sub(r"[”\"»\s]+$", "", text)):
        return "complete"
    words = fold_words(text)
    if len(words) <= 4:
        return "complete"
    tail = fold_words(last)
    marks = len(_INNER_MARK.findall(text))
    if "\n" in text and (_SIGNED.search(last) or len(tail) <= 5 and last.istitle()):
        return "open"
    if _SIGNED.search(last[-40:]) and regex.search(r"(?:@|arroba|\(at\)|dot|ponto)", last[-60:]):
        return "open"
    if marks == 0 and len(words) >= 20 and text[:1].islower() and tail[-1] not in DANGLING:
        return "open"
    return "cut"


def shortened_responses(outputs: DataFrame) -> DataFrame:
    """Distinct responses (one column, `output`) that are proper beginnings of another one."""
    distinct = outputs.where("output is not null and output <> ''").select("output").distinct()
    ordered = materialize(distinct.repartitionByRange("output").sortWithinPartitions("output"))

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = None
        for batch in batches:
            if len(batch) and first is None:
                first = batch["output"].iloc[0]
        if first is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "output": [first]})

    firsts = sorted((r["part"], r["output"]) for r in ordered.mapInPandas(edges, "part int, output string").collect())
    shared = outputs.sparkSession.sparkContext.broadcast(firsts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            texts = ([held] if held is not None else []) + batch["output"].tolist()
            yield pd.DataFrame({"output": [a for a, b in zip(texts, texts[1:]) if b.startswith(a)]}, dtype=object)
            held = texts[-1] if texts else held
        after = next((t for p, t in shared.value if p > part), None)
        if held is not None and after is not None and after.startswith(held):
            yield pd.DataFrame({"output": [held]})

    return ordered.mapInPandas(run, "output string")


def length_limits(unfinished: DataFrame, near: int = 10, factor: float = 8.0, least: int = 8) -> DataFrame:
    """Lengths at which unfinished responses (column `output`) pile up against the mean of the lengths around."""
    counts = unfinished.groupBy(F.length("output").alias("size")).agg(F.count("*").alias("n"))
    around = counts.select(F.explode(F.sequence(F.col("size") - near, F.col("size") + near)).alias("size"), F.col("n").alias("m")).groupBy("size").agg(F.sum("m").alias("m"))
    return counts.join(around, "size").where(F.col("n") >= F.greatest(F.lit(least), factor * (F.col("m") - F.col("n")) / (2 * near))).select("size")


def pair_defects(pairs: DataFrame, model: LanguageModel, words: DataFrame) -> DataFrame:
    """pairs (with instruction, input, output and any other columns) plus `defect`, null where there is none."""
    shared = pairs.sparkSession.sparkContext.broadcast((model, common_words(words)))
    texts = ("instruction", "input", "output")

    @F.pandas_udf("struct<defect:string,ends:string>")
    def judge(instruction: pd.Series, given: pd.Series, output: pd.Series) -> pd.DataFrame:
        rows = []
        for asked, extra, answer in zip(*([x if isinstance(x, str) else None for x in c] for c in (instruction, given, output))):
            if is_empty(answer):
                rows.append(("empty", None))
            elif is_copy(asked, extra, answer):
                rows.append(("copy", None))
            elif is_refusal(asked, answer):
                rows.append(("refusal", None))
            elif in_other_language(*shared.value, asked, answer):
                rows.append(("language", None))
            else:
                ends = ending(answer)
                rows.append(("truncated" if ends == "cut" else None, ends))
        return pd.DataFrame(rows, columns=["defect", "ends"], dtype=object)

    judged = materialize(pairs.withColumn("j", judge(*texts)))
    unsure = judged.where("j.ends = 'open'").select("output").distinct()
    shortened = shortened_responses(pairs).select(F.col("output").alias("short_output")).distinct()
    limits = length_limits(judged.where("j.ends in ('open', 'cut')").select("output")).select(F.col("size").alias("limit_size"))
    evidence = unsure.join(shortened, F.col("output") == F.col("short_output"), "left").join(limits, F.length("output") == F.col("limit_size"), "left")
    cut = evidence.where("short_output is not null or limit_size is not null").select(F.col("output").alias("cut_output"))
    decided = judged.where("j.ends is null or j.ends <> 'open'").withColumn("cut_output", F.lit(None).cast("string"))
    found = decided.unionByName(judged.where("j.ends = 'open'").join(cut, F.col("output") == F.col("cut_output"), "left"))
    late = F.when(F.col("cut_output").isNotNull(), F.lit("truncated"))
    return found.select(*[c for c in pairs.columns if c != "defect"], F.coalesce("j.defect", late).alias("defect"))


def asked_language(model: LanguageModel, common: dict[str, frozenset[str]], asked: str) -> str | None:
    """Language of a question: by common words where one language has most of them, else by the model if it is sure."""
    words = _LETTERS.findall(asked.lower())
    hits = sorted(((sum(w in v for w in words), k) for k, v in common.items()), reverse=True)
    if len(hits) > 1 and hits[0][0] >= 2 and hits[0][0] >= hits[1][0] + 2:
        return hits[0][1]
    found = model.segments(asked)
    return found[0][0] if found and found[0][1] >= 0.9 and (not hits or found[0][0] in [k for n, k in hits if n == hits[0][0]]) else None


def in_other_language(model: LanguageModel, common: dict[str, frozenset[str]], asked: str | None, answer: str) -> bool:
    if not asked or ASKS_LANGUAGE.search(asked):
        return False
    tokens = _LETTERS.findall(answer.lower())
    hits = {k: sum(map(v.__contains__, tokens)) for k, v in common.items()}
    if not hits or len(set(hits.values())) == 1:
        return False
    wanted = asked_language(model, common, asked)
    if wanted is None or hits.get(wanted, 0) == max(hits.values()):
        return False
    found = model.segments(answer)
    total = sum(n for _, _, n in found)
    if total < 5:
        return False
    words: dict[str, int] = {}
    for lang, _, n in found:
        words[lang] = words.get(lang, 0) + n
    main = max(words, key=lambda k: words[k])
    sure = max(c for lang, c, _ in found if lang == main)
    return main != wanted and hits.get(main, 0) > hits.get(wanted, 0) and words[main] >= 0.8 * total and sure >= 0.9
