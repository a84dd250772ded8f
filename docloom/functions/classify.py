"""Ordered text rules: intents, plans, satisfaction, code safety, cross-document questions. All are plain column expressions."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# Patterns by intent, in the order in which they are tried, and the confidence of a hit.
INTENTS = (
    (
        "FILE_GENERATION",
        0.92,
        (
            r"\b(create|generate|make|build|produce|export|save)\s+(a\s+|the\s+)?(csv|word|excel|pdf|spreadsheet|document|diagram|chart|graph)\b",
            r"\b(write|create)\s+(a\s+)?report\b",
            r"\b(export|save)\s+.*\bas\s+(file|csv|excel|pdf|word|xlsx|docx)\b",
            r"\b(export|save)\s+as\s+(file|csv|excel|pdf|word|xlsx|docx)\b",
            r"\b(export|save).*\b(csv|excel|xlsx|pdf|word|docx)\b",
            r"\b(draw|make|create|generate)\s+(a\s+)?(graph|chart|diagram|plot)\b",
            r"\b(create|generate)\s+(a\s+)?spreadsheet\b",
        ),
    ),
    (
        "DATA_ANALYSIS",
        0.90,
        (
            r"\b(csv|excel|xlsx|spreadsheet|dataframe|df\b|column|row|average|mean|sum|count|aggregate|trend|chart|plot|graph|visuali[sz]e|pandas|numpy|calculate|compute)\b",
            r"\bwhat (is|are|was|were) the (total|average|max|min|count|sum)\b",
            r"\bhow many\b.*(row|record|entry|entries)\b",
            r"\bshow me (a |the )?(chart|graph|plot|table|barplot|histogram|boxplot)\b",
            r"\b(analyze|analyse)\s+(this|the|my)?\s*(data|csv|file|table|spreadsheet)\b",
            r"\b(explain|describe|tell me about)\s+(the\s+)?(data|table|spreadsheet|columns?)\b",
            r"\b(distribution|correlation|heatmap|scatter|barplot|histogram|boxplot|violin|outlier|statistics|trend|compare\s+columns?)\b",
            r"\b(preprocess|preprocessing|clean\s+data|data\s+cleaning|feature\s+engineering|missing\s+values?|null\s+values?)\b",
            r"\b(bar\s+chart|pie\s+chart|line\s+chart|bar\s+plot|box\s+plot|violin\s+plot)\b",
        ),
    ),
    (
        "CODE_EXECUTION",
        0.90,
        (
            r"\b(run|execute|write|create)\s+(a\s+)?(python|script|code|program|function)\b",
            r"\b(execute|run)\s+\w+\s+(python|script|code|function)\b",
            r"\b(python|bash|shell)\b.*\b(run|execute|do)\b",
            r"\b(code|script)\s+(for|to|that)\b",
        ),
    ),
    (
        "RESEARCH",
        0.90,
        (
            r"\b(research|investigate|deep\s*dive|find\s*out\s*about|search\s+the\s+web|look\s+up\s+online|latest|current|news\s+about)\b",
            r"\b(comprehensive|thorough|detailed)\s+(analysis|research|study|report)\b",
        ),
    ),
    (
        "CONTENT_GENERATION",
        0.92,
        (
            r"\b(make|create|generate|build|produce)\s+(me\s+)?(a\s+|some\s+|the\s+)?(quiz|flashcards?|flash\s*cards?|presentation|slides|ppt)\b",
            r"\b(quiz|flashcards?|flash\s*cards?)\s+(me|from|on|about)\b",
        ),
    ),
)
DEFAULT_INTENT = ("QUESTION", 0.50)
# Words that ask for a comparison.
COMPARING = ("compare", "comparison", "difference", "differences", "contrast", "vs", "versus", "similarities", "distinguish", "distinguish between", "how do", "what is the difference", "compare and contrast")
# Keywords by tool, in the order in which they are tried.
CONTENT_TOOLS = (
    ("quiz_tool", ("quiz", "test", "question")),
    ("flashcard_tool", ("flashcard", "flash card", "cards")),
    ("ppt_tool", ("presentation", "ppt", "slides", "slide")),
)
# Words by kind of file, in the order in which they are tried.
FILE_KINDS = (
    ("chart", ("chart", "graph", "plot", "diagram", "visuali")),
    ("word", ("word", "docx", "document", "report")),
    ("excel", ("excel", "xlsx", "spreadsheet")),
    ("pdf", ("pdf",)),
    ("csv", ("csv",)),
)
# Words that ask for a change.
EDIT_WORDS = ("add", "update", "fix", "modify", "change", "edit", "replace", "append", "delete", "remove")
# Phrases of contentment with their confidence, and phrases that ask for more, by language.
SATISFIED = {
    "en": (("okay", 0.85), ("ok", 0.85), ("got it", 0.90), ("i see", 0.85), ("makes sense", 0.90), ("understood", 0.90), ("thank you", 0.85), ("thanks", 0.85), ("that's clear", 0.92), ("i understand", 0.90), ("perfect", 0.90), ("great", 0.85), ("alright", 0.85), ("cool", 0.80), ("good", 0.80), ("nice", 0.80), ("right", 0.75), ("yep", 0.85), ("yes", 0.75), ("sure", 0.75), ("fine", 0.80), ("no more questions", 0.95), ("that answers my question", 0.95), ("let's continue", 0.95), ("resume", 0.95), ("move on", 0.92), ("go ahead", 0.92)),
    "hi": (("ठीक है", 0.85), ("समझ गया", 0.90), ("समझ गयी", 0.90), ("अच्छा", 0.85), ("धन्यवाद", 0.85), ("शुक्रिया", 0.85), ("हाँ", 0.75), ("सही है", 0.85), ("ठीक", 0.80), ("बढ़िया", 0.85), ("आगे बढ़ो", 0.92), ("चालू करो", 0.92)),
    "gu": (("સમજાયું", 0.90), ("ઠીક છે", 0.85), ("બરાબર", 0.85), ("આભાર", 0.85), ("હા", 0.75), ("સારું", 0.85), ("આગળ વધો", 0.92), ("ચાલુ કરો", 0.92)),
    "es": (("vale", 0.85), ("entendido", 0.90), ("de acuerdo", 0.85), ("gracias", 0.85), ("perfecto", 0.90), ("bien", 0.80), ("sí", 0.75), ("claro", 0.85), ("continúa", 0.92)),
    "ar": (("حسنا", 0.85), ("فهمت", 0.90), ("شكرا", 0.85), ("تمام", 0.85), ("نعم", 0.75), ("واضح", 0.90), ("استمر", 0.92)),
    "fr": (("d'accord", 0.85), ("compris", 0.90), ("merci", 0.85), ("parfait", 0.90), ("bien", 0.80), ("oui", 0.75), ("c'est clair", 0.90), ("continue", 0.92)),
    "de": (("okay", 0.85), ("verstanden", 0.90), ("danke", 0.85), ("perfekt", 0.90), ("gut", 0.80), ("ja", 0.75), ("klar", 0.85), ("weiter", 0.92), ("alles klar", 0.90)),
    "ja": (("わかりました", 0.90), ("了解", 0.90), ("ありがとう", 0.85), ("はい", 0.75), ("なるほど", 0.85), ("続けて", 0.92), ("大丈夫", 0.85), ("ok", 0.85)),
    "zh": (("好的", 0.85), ("明白了", 0.90), ("谢谢", 0.85), ("懂了", 0.90), ("可以", 0.80), ("继续", 0.92), ("没问题", 0.90), ("对", 0.75)),
    "pt": (("entendido", 0.90), ("obrigado", 0.85), ("ok", 0.85), ("certo", 0.85), ("perfeito", 0.90), ("sim", 0.75), ("claro", 0.85), ("continue", 0.92)),
}
ASKING = {
    "en": ("but", "what about", "can you explain", "why", "how", "tell me more", "what if", "also", "another question", "wait", "hold on", "actually"),
    "hi": ("लेकिन", "क्यों", "कैसे", "और बताओ", "एक और सवाल", "रुको"),
    "gu": ("પણ", "કેમ", "કેવી રીતે", "વધુ કહો", "એક વધુ સવાલ"),
    "es": ("pero", "por qué", "cómo", "explica más", "otra pregunta", "espera"),
    "fr": ("mais", "pourquoi", "comment", "explique plus", "une autre question"),
    "de": ("aber", "warum", "wie", "erkläre mehr", "noch eine frage", "warte"),
    "ja": ("でも", "なぜ", "どう", "もっと教えて", "もう一つ質問"),
    "zh": ("但是", "为什么", "怎么", "再解释", "还有一个问题", "等等"),
    "pt": ("mas", "por que", "como", "explique mais", "outra pergunta"),
    "ar": ("لكن", "لماذا", "كيف", "اشرح أكثر", "سؤال آخر"),
}
# Marks of a question.
QUESTION_MARKS = ("?", "¿", "？", "吗", "か")
# What submitted code must not contain.
FORBIDDEN_CODE = (
    r"\bos\s*\.\s*(system|popen|exec[lv]?[pe]?|spawn|kill|remove|unlink|rmdir|makedirs|rename)",
    r"\bos\s*\.\s*(environ|getenv|putenv|unsetenv)",
    r"\bos\s*\.\s*(chdir|fchdir|chroot)",
    r"\bos\s*\.\s*(listdir|scandir|walk)",
    r"\bos\s*\.\s*(chmod|chown|lchown|chflags)",
    r"\bos\s*\.\s*(link|symlink|readlink)",
    r"\bos\s*\.\s*(fork|wait|waitpid|_exit)",
    r"\bsubprocess\b",
    r"\bshutil\b",
    r"\bsys\s*\.\s*(exit|_exit)",
    r"\b__import__\b",
    r"\bexec\s*\(",
    r"\beval\s*\(",
    r"\bcompile\s*\(",
    r"""\bgetattr\s*\(.*,\s*['"]__""",
    r"\bglobals\s*\(\)",
    r"\blocals\s*\(\)",
    r"\bdelattr\s*\(",
    r"""\bsetattr\s*\(.*,\s*['"]__""",
    r"\b__builtins__\b",
    r"\b__subclasses__\b",
    r"\b__bases__\b",
    r"\b__class__\s*\.\s*__mro__",
    r"\bbreakpoint\s*\(",
    r"""open\s*\([^)]*['"][wa]\+?['"]""",
    r"\bpathlib\b.*\.(write_text|write_bytes|mkdir|unlink|rmdir)",
    r"\bPath\s*\(.*\)\s*\.\s*(write_text|write_bytes|mkdir|unlink|rmdir)",
    r"\bsocket\b",
    r"\brequests\b",
    r"\burllib\b",
    r"\bhttpx\b",
    r"\baiohttp\b",
    r"\bctypes\b",
    r"\bmultiprocessing\b",
    r"\bthreading\b",
    r"\bsignal\b",
    r"\bpickle\b",
)
# Input tokens by model name.
TOKEN_LIMITS = (("gpt-3.5-turbo", 4096), ("gpt-4", 8192), ("gpt-4-32k", 32768), ("claude-2", 100000), ("llama3", 8192), ("llama3.1", 128000), ("gemini-2.5-flash", 1000000), ("qwen3.5", 32768))
DEFAULT_LIMIT = 4096


def has_any(c: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(c, F.lit(p))
    return out


def first_rule(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    out = otherwise
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def intent(message: Column) -> Column:
    """Struct of intent and confidence."""
    low = F.lower(message)
    rules = [(low.rlike("|".join(f"(?:{p})" for p in patterns)), F.struct(F.lit(name).alias("intent"), F.lit(sure).alias("confidence"))) for name, sure, patterns in INTENTS]
    return first_rule(rules, F.struct(F.lit(DEFAULT_INTENT[0]).alias("intent"), F.lit(DEFAULT_INTENT[1]).alias("confidence")))


def compares_documents(question: Column, word_boundary: bool = False) -> Column:
    """Asks across documents. Words match anywhere unless word_boundary is set."""
    low = F.lower(question)
    words = low.rlike("|".join(rf"\b{w}\b" for w in COMPARING)) if word_boundary else has_any(low, COMPARING)
    return words | low.rlike(r"\b\w+\s+vs\.?\s+\w+\b")


def content_tool(message: Column) -> Column:
    """The tool that makes what the message asks for."""
    low = F.lower(message)
    return first_rule([(has_any(low, words), F.lit(tool)) for tool, words in CONTENT_TOOLS], F.lit("rag_tool"))


def file_kind(message: Column) -> Column:
    """The kind of file that the message asks for."""
    low = F.lower(message)
    return first_rule([(has_any(low, words), F.lit(kind)) for kind, words in FILE_KINDS], F.lit("file"))


def wants_edit(message: Column, files: Column) -> Column:
    """There are files, and the message asks to change one."""
    return (F.size(files) > 0) & has_any(F.lower(message), EDIT_WORDS)


def satisfaction(message: Column, language: Column) -> Column:
    """Struct of satisfied (null: can't tell) and confidence."""
    low = F.lower(F.trim(message))
    more, best = has_any(low, ASKING["en"]), _best(low, SATISFIED["en"])
    for name in SATISFIED:
        if name != "en":
            more = F.when(language == name, has_any(low, tuple(p.lower() for p in ASKING[name]))).otherwise(more)
            best = F.when(language == name, _best(low, SATISFIED[name])).otherwise(best)
    answer = lambda yes, sure: F.struct(F.lit(yes).cast("boolean").alias("satisfied"), (sure if isinstance(sure, Column) else F.lit(sure)).alias("confidence"))
    return F.when(more, answer(False, 0.90)).when(best >= 0.85, answer(True, best)).when(has_any(message, QUESTION_MARKS), answer(False, 0.90)).otherwise(answer(None, best))


def _best(low: Column, phrases: tuple[tuple[str, float], ...]) -> Column:
    out = F.lit(0.0)
    for sure in sorted({s for _, s in phrases}):
        out = F.when(has_any(low, tuple(p.lower() for p, s in phrases if s == sure)), F.lit(sure)).otherwise(out)
    return out


def forbidden_code(code: Column) -> Column:
    """The forbidden patterns that code contains."""
    return F.filter(F.array(*[F.lit(p) for p in FORBIDDEN_CODE]), lambda p: F.regexp(code, p))


@F.pandas_udf(BooleanType())
def parses_as_python(code: pd.Series) -> pd.Series:
    """The code has no syntax error (this needs Python's own parser)."""

    def parses(text: str | None) -> bool:
        try:
            ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
        return True

    return code.map(parses)


def token_limit(model: Column) -> Column:
    """By exact name, else by the first name that the model's contains."""
    low = F.lower(model)
    return first_rule([(low == n, F.lit(k)) for n, k in TOKEN_LIMITS] + [(F.contains(low, F.lit(n)), F.lit(k)) for n, k in TOKEN_LIMITS], F.lit(DEFAULT_LIMIT))


def endpoint_kind(path: Column) -> Column:
    """ST03: which limit a request path falls under; null for none."""
    return F.when(path == "/health", None).when(has_any(path, ("/auth/login", "/auth/signup", "/auth/register")), "auth").when(F.contains(path, F.lit("/chat")), "chat").when(has_any(path, ("/flashcard", "/quiz", "/ppt")), "generation")
