"""Content, bias, personal-data, language and blacklist checks as Spark columns (no Python), and topic tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns and words of the checks, case-insensitive.
CONTENT_PATTERNS = {
    "offensive": [
        r"\b(porra|caralho|merda|foder|filho\s*da\s*puta)\b",
        r"\b(desgraça|desgraçado|vagabundo|arrombado)\b",
        r"\b(viado|bicha|sapatão)\b",
        r"\b(preto|negro|macaco)\s+(fedido|imundo|burro)\b",
    ],
    "spam": [
        r"(ganhe\s+dinheiro|fique\s+rico)\s+(rápido|fácil)",
        r"(clique\s+aqui|acesse\s+agora).*http",
        r"(curso\s+gratuito|método\s+secreto)",
        r"(apenas\s+r\$|somente\s+r\$|só\s+r\$)\s*\d+",
        r"(promoção\s+imperdível|última\s+chance)",
        r"(compartilhe|repasse)\s+(para|com)\s+\d+\s+(pessoas|amigos)",
    ],
    "dangerous": [
        r"(como\s+fazer|receita\s+de)\s+(bomba|explosivo)",
        r"(como\s+)?hackear\s+(banco|conta)",
        r"(venda|compra)\s+de\s+(drogas|armas)",
        r"(suicídio|se\s+matar)\s+(como|método)",
    ],
    "copyright": [
        r"(download|baixar)\s+(grátis|gratuito).*?(filme|série|livro|jogo)",
        r"(torrent|pirata|crackeado)",
        r"(site|link)\s+(pirata|ilegal)",
    ],
}
CONTENT_REASON = {"offensive": "contains_offensive_content", "spam": "contains_spam", "dangerous": "contains_dangerous_content", "copyright": "contains_copyright_content"}
BIAS_PATTERNS = [
    (r"mulher(es)?\s+(não\s+)?(sabe|entende|consegue)", "gender", "high"),
    (r"homem\s+(não\s+)?chora", "gender", "medium"),
    (r"trabalho\s+de\s+mulher", "gender", "medium"),
    (r"coisa\s+de\s+(homem|mulher)", "gender", "low"),
    (r"sexo\s+frágil", "gender", "high"),
    (r"lugar\s+de\s+mulher", "gender", "high"),
    (r"(preto|negro)\s+(vagabundo|bandido|ladrão)", "racial", "high"),
    (r"(branco|europeu)\s+(superior|melhor)", "racial", "high"),
    (r"raça\s+(inferior|superior)", "racial", "high"),
    (r"cor\s+da\s+pele.*?(determina|define)", "racial", "medium"),
    (r"(comunista|fascista)\s+(lixo|merda)", "political", "high"),
    (r"(direita|esquerda)\s+(burra|ignorante)", "political", "medium"),
    (r"todo\s+(petista|bolsonarista)\s+(é|são)", "political", "medium"),
    (r"(exterminar|matar)\s+(esquerdista|direitista)", "political", "high"),
    (r"(cristão|judeu|muçulmano|ateu)\s+(idiota|burro)", "religious", "high"),
    (r"(religião|ateísmo)\s+(doença|câncer)", "religious", "high"),
    (r"(crentes|ateus)\s+são\s+todos", "religious", "medium"),
    (r"(velho|idoso)\s+(inútil|imprestável)", "age", "high"),
    (r"(jovem|adolescente)\s+(irresponsável|burro)", "age", "medium"),
    (r"geração\s+\w+\s+(fracassada|perdida)", "age", "medium"),
    (r"(pobre|favelado)\s+(vagabundo|bandido)", "socioeconomic", "high"),
    (r"(rico|burguês)\s+(explorador|ladrão)", "socioeconomic", "medium"),
    (r"(nordestino|baiano)\s+(preguiçoso|burro)", "regional", "high"),
]
PII_PATTERNS = {
    "cpf": r"\b\d{3}[.\s]?\d{3}[.\s]?\d{3}[-.\s]?\d{2}\b",
    "cnpj": r"\b\d{2}[.\s]?\d{3}[.\s]?\d{3}[/.\s]?\d{4}[-.\s]?\d{2}\b",
    "phone": r"\b(?:\+55\s?)?(?:\(?\d{2}\)?[-.\s]?)?\d{4,5}[-.\s]?\d{4}\b",
    "email": r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "cep": r"\b\d{5}[-.\s]?\d{3}\b",
    "rg": r"\b\d{1,2}[.\s]?\d{3}[.\s]?\d{3}[-.\s]?[\dXx]\b",
    "credit_card": r"\b(?:\d{4}[-.\s]?){3}\d{4}\b",
    "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}
ADDRESS_PATTERNS = (r"(?i)\b(rua|av\.|avenida|travessa|alameda)\s+[\w\s]+,?\s*\d+", r"(?i)\bcep\s*:?\s*\d{5}[-.\s]?\d{3}\b")
NAME_PATTERN = (
    r"\b(Maria|José|João|Ana|Paulo|Pedro|Carlos|Lucas|Marcos|Luis|Gabriel|Rafael|Daniel|Fernanda|Juliana|Camila|Larissa|Beatriz|Amanda)\s+"
    r"(?:da\s+|de\s+|dos\s+|das\s+)?[A-Z][a-zà-ú]+(?:\s+[A-Z][a-zà-ú]+)?"
)
PII_LABELS = {"phone": "TELEFONE", "credit_card": "CARTAO", "address": "ENDERECO", "name": "NOME"}
"""What a mask says where that isn't the type itself."""
LANGUAGE_MARKERS = {
    "pt": ["que", "não", "para", "com", "uma", "são", "está", "isso"],
    "en": ["the", "and", "that", "for", "are", "with", "this", "from"],
    "es": ["que", "para", "con", "una", "por", "pero", "como", "esta"],
}
BLACKLIST = {
    "financial_advice": ["strong buy", "strong sell", "price target", "to the moon", "pump", "100x", "hidden gem", "next bitcoin", "investment advice"],
    "harmful": ["kill", "suicide", "hate"],
}
TOPIC_KEYWORDS = {
    "business": ["merger", "acquisition", "earnings", "IPO", "revenue", "ceo"],
    "macroeconomics": ["inflation", "GDP", "interest rate", "central bank", "unemployment"],
    "crypto_assets": ["blockchain", "consensus", "defi", "protocol", "smart contract", "regulation"],
    "technology": ["AI", "artificial intelligence", "quantum", "semiconductor", "cybersecurity"],
}
SEVERITY = ("low", "medium", "high")


def _found(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike("(?iu)" + pattern)


def content_reasons(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(_found(text, "(?:" + "|".join(ps) + ")"), F.lit(CONTENT_REASON[c])) for c, ps in CONTENT_PATTERNS.items()]))


def content_flags(text: Column) -> Column:
    """One entry `category: pattern` for each pattern found."""
    return F.array_compact(F.array(*[F.when(_found(text, p), F.lit(f"{c}: {p[:50]}")) for c, ps in CONTENT_PATTERNS.items() for p in ps]))


def content_confidence(text: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - 0.2 * F.size(content_flags(text)))


def bias_labels(text: Column, least: str = "low") -> Column:
    """Sorted distinct `label:severity` of the bias patterns found, from the least severity on."""
    use = [(p, label, s) for p, label, s in BIAS_PATTERNS if SEVERITY.index(s) >= SEVERITY.index(least)]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(_found(text, p), F.lit(f"{label}:{s}")) for p, label, s in use]))))


def pii_counts(text: Column) -> dict[str, Column]:
    return {k: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p)).cast("long") for k, p in PII_PATTERNS.items()}


def pii_patterns(names: bool = False) -> dict[str, tuple[str, ...]]:
    """All types of personal data with their patterns: PII_PATTERNS, addresses and, if wanted, names."""
    every = {k: (p,) for k, p in PII_PATTERNS.items()} | {"address": ADDRESS_PATTERNS}
    return every | {"name": (NAME_PATTERN,)} if names else every


def all_pii_counts(text: Column, names: bool = False) -> dict[str, Column]:
    """pii_counts with addresses and, if wanted, names; words and spaces of these are those of Unicode, as in Python."""
    rest = {k: sum((F.regexp_count(F.coalesce(text, F.lit("")), F.lit("(?U)" + p)).cast("long") for p in ps), F.lit(0)) for k, ps in pii_patterns(names).items() if k not in PII_PATTERNS}
    return pii_counts(text) | rest


def language_scores(text: Column) -> dict[str, Column]:
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))
    counts = {k: sum((F.contains(padded, F.lit(f" {w} ")).cast("int") for w in ws), F.lit(0)) for k, ws in LANGUAGE_MARKERS.items()}
    total = sum(counts.values(), F.lit(1))
    return {k: c / total for k, c in counts.items()}


def detect_language(df: DataFrame, text: str = "text", targets: tuple[str, ...] = ("pt",), least: float = 0.3) -> DataFrame:
    """df plus detected_lang, confidence and is_target: the marker words of each language that occur, over all that do and one."""
    scored = df.withColumns({f"__{k}": v for k, v in language_scores(F.col(text)).items()})
    best = F.greatest(*[F.col(f"__{k}") for k in LANGUAGE_MARKERS])
    named = F.coalesce(*[F.when((F.col(f"__{k}") == best) & (best > 0), F.lit(k)) for k in LANGUAGE_MARKERS], F.lit("pt"))
    short = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) < 10
    lang, sure = F.when(short, "unknown").otherwise(named), F.when(short, 0.0).when(best > 0, best).otherwise(F.lit(0.5))
    return scored.withColumns({"detected_lang": lang, "confidence": sure}).withColumn("is_target", F.col("detected_lang").isin(*targets) & (F.col("confidence") >= least)).drop(*[f"__{k}" for k in LANGUAGE_MARKERS])


def _alternation(terms: list[str]) -> str:
    import re

    return r"(?<![\p{L}\p{N}_])(?:" + "|".join(re.escape(t).replace(r"\ ", " ") for t in terms) + r")(?![\p{L}\p{N}_])"


def blacklist_passes(text: Column, lists: dict[str, list[str]] = BLACKLIST) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    terms = [t for ts in lists.values() for t in ts]
    return ~(low.rlike(_alternation(terms)) | low.rlike(r"price target of \$\d+"))


def topics(text: Column, keywords: dict[str, list[str]] = TOPIC_KEYWORDS) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike(_alternation([k.lower() for k in ks])), F.lit(t)) for t, ks in sorted(keywords.items())]))


def entities(text: Column) -> Column:
    """Capitalised phrases inside sentences, distinct, longer than two characters."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"(?<!^)(?<!\. )([A-Z][a-z]+(?: [A-Z][a-z]+)*)"), F.lit(1)), lambda e: F.length(e) > 2)))


def health_alerts(loss: Column, grad_norm: Column, ssm_norm: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(F.isnan(loss) | loss.isNull(), F.lit("loss_not_finite")),
            F.when(loss > 15, F.lit("loss_too_high")),
            F.when(grad_norm > 100, F.lit("gradient_explosion")),
            F.when(grad_norm < 1e-7, F.lit("gradient_vanished")),
            F.when(ssm_norm > 50, F.lit("ssm_gradient_high")),
        )
    )


def _breakdown(labels: DataFrame, kind: str) -> DataFrame:
    """(kind, label, n) of an array column `labels`, each label once a row."""
    return labels.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "label", "n")


def _total(df: DataFrame, kind: str, **conditions: Column) -> DataFrame:
    """(kind, label, n): all rows and how many of them meet each condition, in one aggregation."""
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in conditions.items()])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.col(k).alias("n")) for k in ("total", *conditions)]))
    return counts.select(each.alias("s")).select(F.lit(kind).alias("kind"), "s.label", "s.n")


def content_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Counts of texts that pass and fail the content filter, and of texts by reason."""
    judged = df.select(content_reasons(F.col(text)).alias("labels"))
    return _total(judged, "content", passed=F.size("labels") == 0, failed=F.size("labels") > 0).unionByName(_breakdown(judged, "content_reason"))


def bias_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Counts of texts with bias, by type and by their highest severity."""
    judged = df.select(bias_labels(F.col(text)).alias("found"))
    types = judged.select(F.array_distinct(F.transform("found", lambda x: F.split_part(x, F.lit(":"), F.lit(1)))).alias("labels"))
    worst = F.array_max(F.transform("found", lambda x: F.array_position(F.array(*map(F.lit, SEVERITY)), F.split_part(x, F.lit(":"), F.lit(2)))))
    severity = judged.where(F.size("found") > 0).select(F.array(F.element_at(F.array(*map(F.lit, SEVERITY)), worst.cast("int"))).alias("labels"))
    total = _total(judged, "bias", with_bias=F.size("found") > 0, without_bias=F.size("found") == 0)
    return total.unionByName(_breakdown(types, "bias_type")).unionByName(_breakdown(severity, "bias_severity"))


def language_statistics(df: DataFrame, text: str = "text", targets: tuple[str, ...] = ("pt",), least: float = 0.3) -> DataFrame:
    """Counts of texts in the target languages, of low confidence and by language."""
    judged = detect_language(df, text, targets, least)
    total = _total(judged, "language", target=F.col("is_target"), non_target=~F.col("is_target"), low_confidence=F.col("confidence") < least)
    return total.unionByName(_breakdown(judged.select(F.array("detected_lang").alias("labels")), "language_of"))


def language_candidates(text: Column) -> Column:
    """Languages with their shares of the marker words, the likeliest first (ties in the order pt, en, es)."""
    each = F.array(*[F.struct(k_score.alias("share"), F.lit(-i).alias("turn"), F.lit(k).alias("lang")) for i, (k, k_score) in enumerate(language_scores(text).items())])
    found = F.transform(F.reverse(F.array_sort(F.filter(each, lambda c: c["share"] > 0))), lambda c: F.struct(c["lang"].alias("lang"), c["share"].alias("share")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(F.lit("pt").alias("lang"), F.lit(0.5).alias("share"))))
