"""Text expressions: regular expressions with ASCII word borders, noise rules, identifiers, hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[0-9A-Za-z_]"
SPACE = "[\\s\\p{Z}\\uFEFF]"
BORDER = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"


def js_regex(pattern: str) -> str:
    """A pattern whose \\b is an ASCII word border and whose \\s is any white space, for Java's engine."""
    return pattern.replace("\\b", BORDER).replace("[\\s-]", "[\\s\\p{Z}\\uFEFF-]").replace("\\s", SPACE).replace(f"[{SPACE}\\p", "[\\s\\p")


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(js_regex(pattern))


#: All that SPACE matches.
WHITE = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(WHITE))


# Words that carry little information, English and Vietnamese.
STOP_WORDS = """
a an the is it was are been being have has had do does did will would can could should may might shall to of in for on
with at by from as into through during before after above below between out off over under again further then once here
there when where why how all each every both few more most other some such no nor not only own same so than too very just
about up and but or if because until while that this these those i me my myself we our ours you your yours he him his she
her hers its they them their theirs what which who whom am were be having doing must need dare ought used
của và có là trong với không các được người nhưng hoặc như đã sẽ đang này khi từ nếu vì nên mà để cho vào ra lên xuống cùng
tôi bạn anh chị em nó họ chúng ấy đó những một nhiều ít rất hơn kém quá lắm nữa mới cũ vẫn chưa phải bị đều hay thì vậy
""".split()

# Patterns of texts that aren't worth remembering, and the reason given; the first that matches counts.
BLOCKLIST = (
    (r"\benglish\s*(lesson|stud|class|vocab|practice)\b", "english-study note"),
    (r"\b(?:new|today(?:'s)?)?\s*(?:lesson|lession)\b", "english lesson note"),
    (r"\bdùng\s+raining|\bwhen\s+(?:to\s+)?use\s+(?:raining|rainy|sunny)\b", "english word-choice note"),
    (r"\btính\s+danh|\b(?:danh\s+từ|trạng\s+từ|động\s+từ)\b|\bsao\s+để\s+biết", "vietnamese grammar note"),
    (r"\btiếng\s+anh\b|\btừ\s+vựng\b", "vietnamese study note"),
    (r"\b(?:pronunci|spelling|how\s+to\s+pronounce)\b", "pronunciation note"),
    (r"\bweather\b|\brain(y|ing)\b|\bsunny\b", "weather note"),
    (r"\bshopping\s*list\b|\bgrocery\b|going\s+to\s+the\s+store\b", "shopping list"),
    (r"\bbuy(?:ing)?\s+(?:bananas?|bread|milk|yog(?:h)?urt|chicken|fish|food|meat|cheese|rice|fruit|veggie|juice)\b", "grocery item"),
    (r"\blow-fat\s+milk\b|\bplain\s+yogurt\b|\bone\s+list\s+to\s+rule\s+them\s+all\b", "food note"),
    (r"\bstay\s+at\s+home\b|\bmiss\s+breakfast\b|\brelax\s+by\s+reading\b|\bless\s+crowded\b|\bquiet\s+atmosphere\b|\bcharge[d]?\s+(?:my\s+)?phone\b|\bnot\s+to\s+act\b|\bsmart\s+goal\b|\bprocrastin", "lifestyle note"),
    (r"\b--retry-failed\b|\bstuck\s+.*\bscheduling\b|\bscheduling\s+records\b|\bretry\s+(?:the\s+)?(?:failed|failure)\b", "scheduler retry note"),
    (r"\binterview\s+question", "interview note"),
    (r"\btic\s*tac\s*toe\b|\bvision\s+test\b|\bbalance\s+test\b", "non-tech activity note"),
    (r"\bsame\s+(?:input|day[\s-]*day)\s+\w*\s*repeated\s+multiple\s+times\b", "degenerate repeated content"),
)

#: Importance below which a memory of a type is noise; other types take 2.
LEAST_IMPORTANCE = {"KNOWLEDGE": 3, "PREFERENCE": 2, "PATTERN": 3, "MISTAKE": 3, "FEEDBACK": 1, "A2A_SHARED_CONTEXT": 1, "SESSION_SUMMARY": 3}
STOP_SHARE = 0.80


#: For each pattern the strings of which, in one of the groups, a match must hold all: a cheap test before the pattern.
HINTS = (
    ("english",), ("lesson", "lession"), ("raining", "rainy", "sunny"), ("tính danh", "danh", "trạng", "động", "sao"), ("tiếng", "từ"), ("pronunci", "spelling", "pronounce"), ("weather", "rain", "sunny"),
    ("shopping", "grocery", "going"), ("buy",), ("low-fat", "yogurt", "rule"), ("stay", "breakfast", "relax", "crowded", "quiet", "charge", ("not", "to", "act"), "smart", "procrastin"),
    ("--retry-failed", "scheduling", "retry"), ("interview",), (("tic", "tac", "toe"), ("vision", "test"), ("balance", "test")), (("same", "repeated", "times"),),
)


def _hinted(lower: Column, hints) -> Column:
    every = lambda words: reduce(lambda a, b: a & b, (F.contains(lower, F.lit(w)) for w in ((words,) if isinstance(words, str) else words)))
    return reduce(lambda a, b: a | b, map(every, hints))


def blocklist_reason(text: Column) -> Column:
    """"blocklist: <reason>" of the first pattern that matches, else null."""
    lower = F.lower(trim(text))
    return F.coalesce(*(F.when(_hinted(lower, hints) & matches(lower, p), F.lit(f"blocklist: {reason}")) for (p, reason), hints in zip(BLOCKLIST, HINTS, strict=True)))


def stop_share(text: Column) -> Column:
    """The share of stop words among the words, stripped of anything but letters and digits; null without words."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s\p{Z}\uFEFF]+", ""), f"{SPACE}+"), lambda w: w != "")
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))) / F.size(words))


def noise_reason(text: Column, memory_type: Column, importance: Column) -> Column:
    """Why a text isn't worth saving, or null: checks in order, the first that fails counts. A reason names the check, not the sizes it met."""
    content = trim(F.coalesce(text, F.lit("")))
    summary = F.coalesce(memory_type == "SESSION_SUMMARY", F.lit(False))
    least = reduce(lambda rest, kv: F.when(memory_type == kv[0], F.lit(kv[1])).otherwise(rest), LEAST_IMPORTANCE.items(), F.lit(2))
    size = F.length(content)
    return (
        F.when(size == 0, "empty")
        .when(size < F.when(summary, 100).otherwise(40), "too short")
        .when(size > F.when(summary, 5000).otherwise(2000), "too long")
        .when(importance < least, "importance")
        .when(stop_share(content) > STOP_SHARE, "stop words")
        .otherwise(blocklist_reason(content))
    )


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def identifier_words(name: Column, slashes: bool = False) -> Column:
    """The lower-cased words of a camelCase, snake_case or kebab-case name."""
    marks = "[_./-]" if slashes else "[_.-]"
    return F.transform(F.split(name, f"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|{marks}"), lambda p: F.lower(p))


def slug(text: Column, most: int = 64) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def capped_json(text: Column, most: int = 10_000) -> Column:
    """Text of at most so many characters; a notice tells that more was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n... (truncated)"))).otherwise(text)


def tags_of(text: Column) -> Column:
    """Tags from a JSON array or a comma list."""
    listed = F.filter(F.transform(F.split(text, ","), lambda t: trim(t)), lambda t: t != "")
    return F.when(F.startswith(trim(text), F.lit("[")), F.from_json(text, "array<string>")).otherwise(listed)


def tool_request(text: Column) -> Column:
    """struct<tool, params> of a message: JSON with a tool, else its first word."""
    tool = F.get_json_object(text, "$.tool")
    return F.struct(
        F.coalesce(tool, F.nullif(F.get(F.split(trim(text), f"{SPACE}+"), F.lit(0)), F.lit("")), F.lit("default")).alias("tool"),
        F.when(tool.isNotNull(), F.coalesce(F.get_json_object(text, "$.params"), F.lit("{}"))).otherwise(F.lit("{}")).alias("params"),
    )


def episode_value(data: Column) -> Column:
    """What an event's JSON holds: its val if there is one, else the object, else the raw text."""
    return F.coalesce(F.get_json_object(data, "$.val"), data)
