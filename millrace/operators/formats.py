"""Record formats: detection, conversion to chat messages, prompts and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed prompts.
DEFAULT_SYSTEM = "Você é um assistente útil e preciso que fornece informações detalhadas em português brasileiro."
TOPIC_SYSTEM = {
    "financeiro": "Você é um analista financeiro sênior especializado em mercados globais, criptoativos e macroeconomia. Forneça análises factuais, neutras e fundamentadas. Não dê conselhos de investimento diretos (buy/sell). Baseie-se nos dados fornecidos.",
    "tecnologia": "Você é um especialista em tecnologia que explica conceitos técnicos de forma clara e acessível em português brasileiro.",
    "juridico": "Você é um especialista em direito brasileiro que explica conceitos jurídicos de forma clara e precisa.",
    "saude": "Você é um profissional de saúde que fornece informações médicas precisas e responsáveis em português brasileiro.",
    "ciencias": "Você é um cientista que explica conceitos científicos de forma acessível e precisa em português brasileiro.",
    "humanidades": "Você é um especialista em ciências humanas que analisa questões históricas, filosóficas e sociais com profundidade.",
    "cultura": "Você é um especialista em cultura brasileira e mundial que fornece análises culturais aprofundadas.",
    "negocios": "Você é um consultor de negócios experiente que fornece insights estratégicos e práticos.",
    "educacao": "Você é um educador experiente que explica conceitos de forma didática e acessível.",
    "meio_ambiente": "Você é um especialista em meio ambiente e sustentabilidade que fornece análises baseadas em evidências científicas.",
}

# Fixed instruction templates by topic, and those for other topics.
TOPIC_TEMPLATES = {
    "financeiro": [
        "Explique sobre {title}.",
        "O que você sabe sobre {topic} relacionado a finanças?",
        "Forneça informações detalhadas sobre {title}.",
        "Descreva {title} no contexto financeiro brasileiro.",
        "Como funciona {title}?",
    ],
    "tecnologia": [
        "Explique o conceito de {title}.",
        "O que é {title} em tecnologia?",
        "Descreva como funciona {title}.",
        "Forneça uma explicação técnica sobre {title}.",
        "Quais são os principais aspectos de {title}?",
    ],
    "ciencias": [
        "Explique o fenômeno/conceito de {title}.",
        "O que a ciência diz sobre {title}?",
        "Descreva {title} cientificamente.",
        "Quais são as bases científicas de {title}?",
    ],
    "saude": [
        "O que é {title} na área da saúde?",
        "Explique sobre {title} do ponto de vista médico.",
        "Forneça informações sobre {title} relacionado à saúde.",
        "Descreva {title} e sua importância para a saúde.",
    ],
    "juridico": [
        "Explique o aspecto jurídico de {title}.",
        "O que diz a lei brasileira sobre {title}?",
        "Descreva {title} do ponto de vista legal.",
        "Quais são os aspectos legais de {title}?",
    ],
    "humanidades": [
        "Explique {title} do ponto de vista histórico/filosófico.",
        "O que sabemos sobre {title} nas ciências humanas?",
        "Descreva a importância de {title} para a sociedade.",
        "Analise {title} sob a perspectiva humanística.",
    ],
    "cultura": [
        "Fale sobre {title} na cultura brasileira.",
        "O que representa {title} culturalmente?",
        "Descreva a importância cultural de {title}.",
        "Como {title} influencia a cultura?",
    ],
    "negocios": [
        "Explique {title} no contexto empresarial.",
        "Como funciona {title} nos negócios?",
        "Descreva {title} para empreendedores.",
        "Quais são as melhores práticas de {title}?",
    ],
    "educacao": [
        "Explique {title} no contexto educacional.",
        "Como {title} se aplica à educação?",
        "Descreva a importância de {title} para o aprendizado.",
    ],
    "meio_ambiente": [
        "Explique {title} no contexto ambiental.",
        "Qual a importância de {title} para o meio ambiente?",
        "Descreva {title} e seu impacto ambiental.",
    ],
}
DEFAULT_TEMPLATES = ["Forneça informações sobre {title}.", "Explique {title}.", "O que você sabe sobre {title}?", "Descreva {title} em detalhes."]
ENTRY_SYSTEM = {
    "default": "Você é um assistente útil e preciso que fornece informações detalhadas em português brasileiro.",
    "financeiro": "Você é um especialista em finanças e economia que fornece informações precisas sobre o mercado financeiro brasileiro.",
    "tecnologia": "Você é um especialista em tecnologia que explica conceitos técnicos de forma clara e acessível.",
    "juridico": "Você é um especialista em direito brasileiro que explica conceitos jurídicos de forma clara.",
    "saude": "Você é um profissional de saúde que fornece informações médicas precisas e responsáveis.",
    "ciencias": "Você é um cientista que explica conceitos científicos de forma acessível e precisa.",
}


def detect_format(columns: dict[str, Column]) -> Column:
    """chatml, sharegpt, alpaca or unknown by the fields that are present (not null)."""
    have = lambda c: columns[c].isNotNull() if c in columns else F.lit(False)
    return F.when(have("messages"), "chatml").when(have("conversations"), "sharegpt").when(have("instruction") & have("output"), "alpaca").otherwise("unknown")


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def alpaca_messages(instruction: Column, given: Column, output: Column, system: Column | None = None) -> Column:
    user = F.when(F.coalesce(given, F.lit("")) != "", F.concat(F.coalesce(instruction, F.lit("")), F.lit("\n\nContexto: "), given)).otherwise(F.coalesce(instruction, F.lit("")))
    return F.array(message("system", system if system is not None else F.lit(DEFAULT_SYSTEM)), message("user", user), message("assistant", F.coalesce(output, F.lit(""))))


def sharegpt_messages(conversations: Column) -> Column:
    """human and gpt turns as user and assistant after a default system message; other turns are dropped."""
    kept = F.filter(conversations, lambda t: t["from"].isin("human", "gpt"))
    turned = F.transform(kept, lambda t: message(F.when(t["from"] == "human", "user").otherwise("assistant"), t["value"]))
    return F.concat(F.array(message("system", F.lit(DEFAULT_SYSTEM))), turned)


def topic_prompt(topic: Column) -> Column:
    prompts = F.create_map(*[F.lit(x) for pair in TOPIC_SYSTEM.items() for x in pair])
    return F.coalesce(F.try_element_at(prompts, F.coalesce(topic, F.lit(""))), F.lit(DEFAULT_SYSTEM))


def with_topic_prompt(messages: Column, topic: Column) -> Column:
    """The first system message replaced by the topic's prompt, where there is one."""
    prompts = F.create_map(*[F.lit(x) for pair in TOPIC_SYSTEM.items() for x in pair])
    prompt = F.try_element_at(prompts, F.coalesce(topic, F.lit("")))
    first = F.array_position(F.transform(messages, lambda m: m["role"]), "system")
    return F.transform(messages, lambda m, i: F.when(prompt.isNotNull() & (i + 1 == first), message("system", prompt)).otherwise(m))


def render_chat(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")


def fill_template(template: Column) -> Column:
    titled = F.replace(template, F.lit("{title}"), F.coalesce(F.col("title"), F.col("topic"), F.lit("")))
    return F.replace(titled, F.lit("{topic}"), F.coalesce(F.col("topic"), F.lit("")))


def _lookup(table: dict[str, Column], topic: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), v)]), F.coalesce(topic, F.lit("")))


def pick_template(topic: Column, key: Column, seed: int = 0) -> Column:
    """One of the topic's templates (or the default ones), chosen evenly by a hash of the seed and the key."""
    lists = {k: F.array(*map(F.lit, v)) for k, v in TOPIC_TEMPLATES.items()}
    choice = F.coalesce(_lookup(lists, topic), F.array(*map(F.lit, DEFAULT_TEMPLATES)))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 8), 16, 10).cast("long")
    return F.element_at(choice, (draw % F.size(choice) + 1).cast("int"))


def entry_system(topic: Column) -> Column:
    return F.coalesce(_lookup({k: F.lit(v) for k, v in ENTRY_SYSTEM.items() if k != "default"}, topic), F.lit(ENTRY_SYSTEM["default"]))


def entry_formats(entries: DataFrame, seed: int = 0, metadata: bool = False) -> DataFrame:
    """id with the alpaca, sharegpt and chatml forms of an entry as JSON, with a template of its topic; with metadata, each
    form has the entry's id, source, topic and quality score (0.7 where there is none)."""
    instruction, text = fill_template(pick_template(F.col("topic"), F.col("id"), seed)), F.coalesce("text", F.lit(""))
    extra = [F.struct("id", F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce("quality_score", F.lit(0.7)).alias("quality_score")).alias("metadata")] if metadata else []
    turns = F.array(F.struct(F.lit("human").alias("from"), instruction.alias("value")), F.struct(F.lit("gpt").alias("from"), text.alias("value")))
    chat = F.array(message("system", entry_system(F.col("topic"))), message("user", instruction), message("assistant", text))
    alpaca = F.struct(instruction.alias("instruction"), F.lit("").alias("input"), text.alias("output"), *extra)
    return entries.select("id", F.to_json(alpaca).alias("alpaca"), F.to_json(F.struct(turns.alias("conversations"), *extra)).alias("sharegpt"), F.to_json(F.struct(chat.alias("messages"), *extra)).alias("chatml"))
