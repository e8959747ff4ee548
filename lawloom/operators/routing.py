"""Questions to routes: history, intents, rule and model decisions, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.functions.text import collapse, fold_collapsed, let, strip
from lawloom.operators.ordered import top_per_key

HISTORY_MESSAGES = 12
RETRIEVAL_MESSAGES = 8
HISTORY_CHARS = 1800
MIN_CONFIDENCE = 0.55
LOW_CONTEXT_CONFIDENCE = 0.75
DIRECTORY_CONFIDENCE = 0.8

# Route names.
EXACT, APPENDIX, AMENDMENT = "exact_legal_lookup", "appendix_lookup", "amendment_lookup"
DIRECTORY, BROAD, LOW = "lecturer_lookup", "broad_semantic_rag", "low_context_or_invalid"
STRATEGIES = (EXACT, APPENDIX, AMENDMENT, DIRECTORY, BROAD, LOW)

# Folded keywords of each intent.
LIST_TERMS = (
    "danh sach", "liet ke", "cac giang vien", "nhung giang vien", "giang vien khoa", "giang vien bo mon",
    "thuoc khoa", "thuoc bo mon", "khoa cntt", "cong nghe thong tin", "bo mon",
)
PEOPLE_TERMS = (
    "giang vien", "giao vien", "can bo", "nhan su", "tro giang", "thinh giang", "ly lich khoa hoc",
)
CONTACT_TERMS = ("email", "mail", "dien thoai", "so dien thoai", "sdt", "lien he", "thong tin")
DIRECTORY_TERMS = (
    "danh sach", "thuoc khoa", "thuoc bo mon", "bo mon nao", "khoa nao", "la ai", "ten giang vien",
)
LEGAL_TERMS = ("quy dinh", "quy che", "dieu kien", "nghia vu", "trach nhiem", "hoc vu", "dao tao")
AMENDMENT_TERMS = (
    "sua doi", "bo sung", "bai bo", "thay the", "hien hanh", "ban moi", "ban cu", "khac biet",
)
APPENDIX_TERMS = (
    r"phu\s*luc", r"bieu\s*mau", r"mau\s+don", r"mau\s+phieu", r"mau\s+van\s+ban", r"bang\s+quy\s+doi",
    r"quy\s+doi", r"khung\s+nang\s+luc", r"danh\s+muc\s+trong\s+phu\s*luc",
)
NOT_APPENDIX_TERMS = (
    r"diem\s+chuan", r"diem\s+cac\s+nganh", r"diem\s+nganh", r"nganh\s+trong\s+diem",
    r"khoa\s+hoc\s+du\s+lieu", r"tuyen\s+sinh", r"xet\s+tuyen",
)

_WORD = r"[\p{L}\p{N}_]"


def _has(text: Column, terms: tuple[str, ...]) -> Column:
    return text.rlike("|".join(terms))


def _has_word(text: Column, *patterns: str) -> Column:
    return text.rlike(rf"(?<!{_WORD})(?:{'|'.join(patterns)})(?!{_WORD})")


# --- intents on folded text ---------------------------------------------------------


def article_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, rf"(?<!{_WORD})dieu\s+(\d+[a-z]?)(?!{_WORD})", 1), F.lit(""))


def appendix_number(text: Column) -> Column:
    found = F.regexp_extract(text, rf"(?<!{_WORD})phu\s*luc\s+([ivxlcdm]+|\d+)(?!{_WORD})", 1)
    return F.upper(F.nullif(found, F.lit("")))


def wants_list(text: Column) -> Column:
    return _has(text, LIST_TERMS)


def wants_directory(text: Column) -> Column:
    people, contact, directory = _has(text, PEOPLE_TERMS), _has(text, CONTACT_TERMS), _has(text, DIRECTORY_TERMS)
    legal_only = _has(text, LEGAL_TERMS) & ~(contact | directory)
    return ~legal_only & (people | (contact & _has_word(text, "cua")) | (directory & contact))


def wants_appendix(text: Column) -> Column:
    excluded = _has_word(text, *NOT_APPENDIX_TERMS) & ~_has_word(text, r"phu\s*luc")
    return ~excluded & _has_word(text, *APPENDIX_TERMS)


def wants_amendment(text: Column) -> Column:
    return _has(text, AMENDMENT_TERMS)


# --- routes ----------------------------------------------------------------------------

ROUTE = (
    "struct<strategy:string,filters:map<string,string>,top_k:int,candidate_top_k:int,"
    "use_expansion:boolean,use_related:boolean,confidence:double,rejected:string>"
)


def _route(
    strategy: str,
    top_k: Column,
    candidates: Column,
    filters: Column | None = None,
    expand: bool = False,
    related: bool = True,
    confidence: Column | None = None,
    rejected: str | None = None,
) -> Column:
    return F.struct(
        F.lit(strategy).alias("strategy"),
        (F.create_map().cast("map<string,string>") if filters is None else filters).alias("filters"),
        top_k.cast("int").alias("top_k"),
        candidates.cast("int").alias("candidate_top_k"),
        F.lit(expand).alias("use_expansion"),
        F.lit(related).alias("use_related"),
        (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence"),
        F.lit(rejected).cast("string").alias("rejected"),
    )


def _only_set(*pairs: tuple[str, Column]) -> Column:
    """A map of the pairs whose value is not NULL."""
    full = F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v.cast("string") for _, v in pairs]))
    return F.map_filter(full, lambda k, v: v.isNotNull())


def _broad(k: Column, **more) -> Column:
    return _route(BROAD, k, F.greatest(k * 4, F.lit(12)), expand=True, **more)


def _exact(k: Column, article: Column, **more) -> Column:
    return _route(EXACT, k, F.greatest(k * 3, F.lit(8)), _only_set(("article_number", article)), **more)


def _appendix(k: Column, number: Column, **more) -> Column:
    filters = _only_set(("chunk_kind", F.lit("appendix")), ("appendix_number", number))
    return _route(APPENDIX, k, F.greatest(k * 4, F.lit(12)), filters, **more)


def _amendment(k: Column, article: Column, **more) -> Column:
    filters = _only_set(("is_amendment", F.lit("true")), ("article_number", article))
    return _route(AMENDMENT, k, F.greatest(k * 5, F.lit(15)), filters, expand=True, **more)


def _directory(text: Column, k: Column, **more) -> Column:
    chosen = F.when(wants_list(text), F.greatest(k, F.lit(10))).otherwise(k)
    filters = _only_set(("chunk_kind", F.lit("Lecturer")))
    return _route(DIRECTORY, chosen, F.greatest(chosen * 3, F.lit(15)), filters, related=False, **more)


def rule_route(text: Column, k: Column) -> Column:
    """Article number, directory, appendix, amendment, in that order; NULL when nothing applies."""
    nothing = F.lit(None).cast("string")
    return (
        F.when(article_number(text).isNotNull(), _exact(k, article_number(text)))
        .when(wants_directory(text), _directory(text, k))
        .when(appendix_number(text).isNotNull() | wants_appendix(text), _appendix(k, appendix_number(text)))
        .when(wants_amendment(text), _amendment(k, nothing))
    )


def confidence_of(value: Column) -> Column:
    """Clamped to 0..1; anything that is not a number is 0."""
    number = F.coalesce(value.try_cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(number, F.lit(1.0)))


def _token(value: Column) -> Column:
    token = F.lower(strip(value))
    return F.when((token != "") & (token != "null"), token)


DECISION = "struct<strategy:string,article_number:string,appendix_number:string,confidence:string,reason:string>"


def json_object(c: Column) -> Column:
    """The JSON object in a model's answer: the whole text, else its outermost braces; NULL when there is none."""
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.coalesce(_object_or_null(c, F.try_parse_json(c)), _object_or_null(inner, F.try_parse_json(inner), c))


def _object_or_null(text: Column, parsed: Column, outer: Column | None = None) -> Column:
    kind = F.schema_of_variant(parsed)
    is_object = parsed.isNotNull() & F.startswith(kind, F.lit("OBJECT"))
    if outer is not None:  # braces inside a text that is itself valid JSON do not count
        is_object = is_object & F.try_parse_json(outer).isNull()
    return F.when(is_object, text)


def model_decision(c: Column) -> Column:
    return F.from_json(json_object(c), DECISION)


def expansion_list(query: Column, c: Column) -> Column:
    """The JSON list of a model's expansion answer, its non-empty items; anything else gives [query]."""
    parsed = F.try_parse_json(c)
    is_list = parsed.isNotNull() & F.startswith(F.schema_of_variant(parsed), F.lit("ARRAY"))
    items = F.filter(F.from_json(c, "array<string>"), lambda x: x.isNotNull() & (strip(x) != ""))
    return F.when(is_list, items).otherwise(F.array(query))


def model_route(text: Column, k: Column, decision: Column) -> Column:
    """A validated model decision as a route; NULL when it is unusable."""
    confidence = confidence_of(decision["confidence"])
    strategy = strip(decision["strategy"])
    article = F.coalesce(article_number(text), _token(decision["article_number"]))
    number = F.coalesce(appendix_number(text), F.upper(_token(decision["appendix_number"])))
    low_route = _route(LOW, k, F.lit(12), confidence=confidence)
    return F.when(
        decision.isNotNull() & (confidence >= MIN_CONFIDENCE),
        F.when((strategy == EXACT) & article.isNotNull(), _exact(k, article, confidence=confidence))
        .when(
            (strategy == DIRECTORY) & ~wants_directory(text) & (confidence < DIRECTORY_CONFIDENCE),
            _broad(k, confidence=confidence, rejected=DIRECTORY),
        )
        .when(strategy == DIRECTORY, _directory(text, k, confidence=confidence))
        .when(
            (strategy == APPENDIX) & number.isNull() & ~wants_appendix(text),
            _broad(k, confidence=confidence, rejected=APPENDIX),
        )
        .when(strategy == APPENDIX, _appendix(k, number, confidence=confidence))
        .when(
            (strategy == AMENDMENT) & ~wants_amendment(text), _broad(k, confidence=confidence, rejected=AMENDMENT)
        )
        .when(strategy == AMENDMENT, _amendment(k, article, confidence=confidence))
        .when((strategy == LOW) & (confidence >= LOW_CONTEXT_CONFIDENCE), low_route)
        .when(strategy == BROAD, _broad(k, confidence=confidence)),
    )


def choose_route(text: Column, k: Column, rules: Column, model: Column) -> Column:
    """One word or less is low context; rules win over a missing, broad or low-context model route."""
    words = F.size(F.filter(F.split(text, " "), lambda w: w != ""))
    low = _route(LOW, k, F.lit(12))
    weak = model.isNull() | model["strategy"].isin(BROAD, LOW)
    return F.when(words <= 1, low).when(rules.isNotNull() & weak, rules).otherwise(F.coalesce(model, rules, _broad(k)))


def route_questions(
    questions: DataFrame, text: str = "question", top_k: int = 3, model_answer: str | None = None
) -> DataFrame:
    """Adds normalized_query and route."""
    k = F.lit(top_k)
    normalized = questions.withColumn("normalized_query", fold_collapsed(F.col(text)))
    folded = F.col("normalized_query")
    routed = normalized.withColumn("__rules", rule_route(folded, k))
    if model_answer is None:
        routed = routed.withColumn("__model", F.lit(None).cast(ROUTE))
    else:
        routed = routed.withColumn("__decision", model_decision(F.col(model_answer))).withColumn(
            "__model", model_route(folded, k, F.col("__decision"))
        ).drop("__decision")
    chosen = choose_route(folded, k, F.col("__rules"), F.col("__model"))
    return routed.withColumn("route", chosen).drop("__rules", "__model")


# --- history ---------------------------------------------------------------------------


def recent_messages(messages: DataFrame, limit: int = HISTORY_MESSAGES, spoken_only: bool = True) -> DataFrame:
    """The last messages of each session, numbered from the newest (``back`` = 1).

    ``spoken_only`` keeps user and assistant messages with text. Each task keeps ``limit`` rows per session
    before the shuffle, so long sessions do not gather in one place.
    """
    kept = messages
    if spoken_only:
        kept = messages.withColumn("content", strip(F.col("content"))).filter(
            strip(F.col("role")).isin("user", "assistant") & (F.col("content") != "")
        )
    return top_per_key(kept, ["session_id"], [F.col("created_at").desc(), F.col("message_id").desc()], limit, "back")


def message_label(role: Column) -> Column:
    return F.when(role == "user", F.lit("Nguoi dung")).otherwise(F.lit("Tro ly"))


def history_lines(recent: DataFrame, limit: int, skip: int = 0) -> DataFrame:
    """The newest ``limit`` messages of each session after ``skip``, oldest first, one labelled line each."""
    line = F.concat(message_label(F.col("role")), F.lit(": "), F.col("content"))
    return (
        recent.filter((F.col("back") > skip) & (F.col("back") <= limit + skip))
        .withColumn("line", line)
        .groupBy("session_id")
        .agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY back DESC)").alias("history"))
    )


def retrieval_query(question: Column, history: Column, max_chars: int = HISTORY_CHARS) -> Column:
    """The question with the tail of its history; the bare question without one."""
    tail = F.right(history, F.lit(max_chars))
    full = F.concat(F.lit("Lich su hoi thoai gan day:\n"), tail, F.lit("\n\nCau hoi hien tai:\n"), question)
    return F.when(F.coalesce(history, F.lit("")) == "", question).otherwise(strip(full))


def last_questions(messages: DataFrame, limit: int = RETRIEVAL_MESSAGES) -> DataFrame:
    """Per session: its newest user message as ``question`` and the messages right before it as ``history``."""
    at = F.struct("created_at", "message_id")
    asked = (
        messages.filter(F.col("role") == "user")
        .groupBy("session_id")
        .agg(F.max_by(F.struct(at.alias("at"), strip(F.col("content")).alias("question")), at).alias("q"))
    )
    earlier = messages.join(asked, "session_id").filter(at < F.col("q.at")).drop("q")
    history = history_lines(recent_messages(earlier, limit), limit)
    return asked.join(history, "session_id", "left").select("session_id", "q.question", "history")


# --- prompts ----------------------------------------------------------------------------


def time_context(now: Column, zone: str = "Asia/Ho_Chi_Minh") -> Column:
    """Facts about the current time; ``now`` is a UTC timestamp column, so a replayed run gives the same text."""
    local = F.from_utc_timestamp(now, zone)
    return F.concat(
        F.lit("Ngày hiện tại: "), F.date_format(local, "dd/MM/yyyy"),
        F.lit("\nGiờ hiện tại: "), F.date_format(local, "HH:mm:ss"),
        F.lit(f"\nMúi giờ: {zone}\nTháng hiện tại: "), F.month(local).cast("string"),
        F.lit("\nNăm hiện tại: "), F.year(local).cast("string"),
    )


def answer_prompt(question: Column, context: Column, history: Column, now: Column, instructions: str = "") -> Column:
    """Time, history, context and question sections; the wording of the instructions is a parameter."""
    past = F.concat(F.lit("[CHAT_HISTORY]\n"), F.nullif(history, F.lit("")), F.lit("\n[/CHAT_HISTORY]"))
    return F.concat_ws(
        "\n\n",
        time_context(now),
        past,
        F.nullif(F.lit(instructions), F.lit("")),
        F.concat(F.lit("[CONTEXT]\n"), F.coalesce(context, F.lit("")), F.lit("\n[/CONTEXT]")),
        F.concat(F.lit("[QUESTION]\n"), question, F.lit("\n[/QUESTION]")),
    )


def low_context_prompt(question: Column, history: Column, now: Column, instructions: str = "") -> Column:
    past = F.concat(F.lit("[CHAT_HISTORY]\n"), F.nullif(history, F.lit("")), F.lit("\n[/CHAT_HISTORY]"))
    return F.concat_ws("\n\n", time_context(now), past, F.nullif(F.lit(instructions), F.lit("")), question)


# Labels of the question in the prompts that expand and route it.
EXPAND_LABEL, ROUTE_LABEL = "Câu hỏi cần mở rộng: ", "Câu hỏi: "


def expand_prompt(question: Column, now: Column, instructions: str = "") -> Column:
    """Time, instructions and the question to write search queries for (see ``expansion_list`` for the answer)."""
    return F.concat_ws("\n\n", time_context(now), F.nullif(F.lit(instructions), F.lit("")), F.concat(F.lit(EXPAND_LABEL), question))


def route_prompt(question: Column, now: Column, instructions: str = "") -> Column:
    """Time, instructions and the question to route (see ``model_decision`` for the answer)."""
    return F.concat_ws("\n\n", time_context(now), F.nullif(F.lit(instructions), F.lit("")), F.concat(F.lit(ROUTE_LABEL), question))
