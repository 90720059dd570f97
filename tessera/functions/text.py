"""Scalar text functions as column expressions (and, where a query text is one value, plain Python)."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Redaction rules in order (label, pattern, value class or None). A rule with a value
#: class replaces only the value after its pattern; the others replace the whole match. What each rule's
#: matches hold in lower case is in REDACTION_MARKS.
REDACTION_RULES = (
    ("private-key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", None),
    ("api-key", r"(?U)\bsk-[A-Za-z0-9_\-]{16,}", None),
    ("api-key", r"(?U)\b(?:ghp|gho|ghu|ghs|ghr|github_pat)_[A-Za-z0-9_]{16,}", None),
    ("api-key", r"(?U)\bxox[abprs]-[A-Za-z0-9\-]{10,}", None),
    ("api-key", r"(?U)\bAKIA[0-9A-Z]{16}\b", None),
    ("bearer", r"(?iU)\b(?:bearer|authorization:\s*bearer)\s+", (r"[A-Za-z0-9._\-]", 16, "")),
    ("connection-string", r"(?U)://[^\s/:@]+:", (r"[^\s/@\\]", 3, "@")),
    (
        "secret-assignment",
        r"(?iU)[\w.\-]*(?:password|passwd|secret|api[_-]?key|apikey|access[_-]?token|auth[_-]?token|client[_-]?secret|private[_-]?token)[\w.\-]*\s*[:=]\s*[\"']?",
        (r"[^\s\"',;)\\]", 6, ""),
    ),
)
#: A non-character that stands for a value just found; texts don't hold it.
_FOUND = "￿"


#: Strings of which a match of each rule holds one, in lower case (and with a long s as s).
REDACTION_MARKS = (("-----begin",), ("sk-",), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), ("xox",), ("akia",), ("bearer",), ("://",), ("passw", "secret", "api", "token"))


def once(v: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often `use` names it."""
    return F.get(F.transform(F.array(v), use), F.lit(0))


def holds_any(low: Column, marks: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (F.contains(low, F.lit(m)) for m in marks))


def lowered(text: Column) -> Column:
    """Lower case as patterns that ignore case see it: a long s is an s."""
    return F.translate(F.lower(text), "ſ", "s")


def redact(text: Column) -> Column:
    """struct(text, hits): secrets replaced by `[redacted:label]`, and how many. Idempotent; null stays null with 0 hits.

    A value that is a placeholder already is kept, and what is glued to it is passed over with it:
    a match first becomes its prefix and a mark, marks after placeholders go, the rest are hits.
    A rule's pattern runs only on texts that hold one of its marks. Each step is a function of the step
    before (a `transform` of one element), so nothing is computed twice.
    """

    def state(text_: Column, low: Column, hits: Column) -> Column:
        return F.struct(text_.alias("text"), low.alias("low"), hits.cast("int").alias("hits"))

    def step(label: str, pattern: str, value: tuple[str, int, str] | None, marks: tuple[str, ...]):
        placeholder = F.lit(f"[redacted:{label}]")

        def whole(s: Column) -> Column:
            times = F.coalesce(F.regexp_count(s["text"], F.lit(pattern)), F.lit(0))
            return state(F.regexp_replace(s["text"], F.lit(pattern), placeholder), s["low"], s["hits"] + times)

        def after_prefix(s: Column) -> Column:
            one, least, after = value
            body = rf"({pattern.partition(')')[2]})(?:(\[redacted:{one}*)|{one}{{{least},}})"
            marked = F.regexp_replace(s["text"], F.lit(pattern.partition(")")[0] + ")" + body + (f"(?={after})" if after else "")), F.lit(f"$1$2{_FOUND}"))
            marked = F.regexp_replace(marked, F.lit(rf"(?U)(\[redacted:{one}*){_FOUND}"), F.lit("$1"))
            return F.get(F.transform(F.array(marked), lambda m: state(F.replace(m, F.lit(_FOUND), placeholder), s["low"], s["hits"] + F.length(m) - F.length(F.replace(m, F.lit(_FOUND), F.lit(""))))), F.lit(0))

        return lambda s: F.when(holds_any(s["low"], marks), whole(s) if value is None else after_prefix(s)).otherwise(s)

    steps = F.array(state(text, lowered(text), F.lit(0)))
    for rule, marks in zip(REDACTION_RULES, REDACTION_MARKS, strict=True):
        steps = F.transform(steps, step(*rule, marks))
    return F.get(F.transform(steps, lambda s: F.struct(s["text"].alias("text"), s["hits"].alias("hits"))), F.lit(0))


#: A query's tokens, and the letters counted as CJK when content is indexed.
_TOKEN = r"[A-Za-z0-9_./:@-]+|[一-鿿]+"
_CJK = r"[぀-ヿ㐀-䶿一-鿿가-힯]+"


def tokenize(query: str) -> list[str]:
    """Tokens of one query: ASCII words of two characters or more in lower case, CJK runs and their bigrams; each once, in order."""
    out: dict[str, None] = {}
    for run in re.findall(_TOKEN, query or ""):
        if run[0] < "一":
            if len(run) >= 2:
                out[run.lower()] = None
        else:
            out[run] = None
            for i in range(len(run) - 1):
                out[run[i : i + 2]] = None
    return list(out)


def tokens_of(text: Column) -> Column:
    """The same for a column: an array of tokens."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))

    def each(run: Column) -> Column:
        bigrams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        cjk = F.rlike(run, F.lit(r"^[一-鿿]"))
        short = F.when(F.length(run) >= 2, F.array(F.lower(run))).otherwise(F.array().cast("array<string>"))
        return F.when(cjk, F.concat(F.array(run), F.when(F.length(run) >= 2, bigrams).otherwise(F.array().cast("array<string>")))).otherwise(short)

    return F.array_distinct(F.flatten(F.transform(runs, each)))


def coverage(tokens: list[str], content: Column) -> Column:
    """Share of the tokens that occur in the lower-cased content; 0 without tokens."""
    if not tokens:
        return F.lit(0.0)
    low = F.lower(content)
    hit = sum((F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in tokens), F.lit(0))
    return hit.cast("double") / len(tokens)


def cjk_run_list(text: Column) -> Column:
    """CJK runs (kana, hangul and ideographs) of a text, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_CJK), F.lit(0))


def cjk_run_list_of(text: str) -> list[str]:
    return re.findall(_CJK, text or "")


def cjk_runs(text: Column) -> Column:
    """CJK runs joined by a blank; null if there are none."""
    runs = cjk_run_list(text)
    return F.when(F.size(runs) > 0, F.array_join(runs, " "))


def snippet(content: Column, tokens: list[str], width: int = 180) -> Column:
    """White space collapsed, cut around the first token (in token order) that occurs, with an ellipsis on each cut side."""
    flat = F.trim(F.regexp_replace(content, r"(?U)\s+", " "))
    low = F.lower(flat)
    at = F.coalesce(*(F.nullif(F.instr(low, t), F.lit(0)) for t in tokens), F.lit(1)) if tokens else F.lit(1)
    start = F.greatest(at - 61, F.lit(0))
    end = F.least(F.length(flat), start + width)
    body = F.substring(flat, start + 1, end - start)
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < F.length(flat), "…").otherwise(""))


#: Fixed value: characters of a chunk.
CLIP = 6000


def clip(text: Column, most: int = CLIP) -> Column:
    """Text cut to `most` characters plus an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def normalise_title(text: Column) -> Column:
    """White space collapsed, at most 255 characters, null if empty."""
    return F.nullif(F.substring(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 1, 255), F.lit(""))


def next_title(old: Column, old_source: Column, new: Column) -> Column:
    """A title given by the user outlives a new capture."""
    return F.when((old_source == "user") & old.isNotNull(), old).otherwise(F.coalesce(new, old))


def normalise_path(path: Column) -> Column:
    """Back slashes turned, trimmed, a leading ./ dropped, null if empty."""
    return F.nullif(F.regexp_replace(F.trim(F.replace(path, F.lit("\\"), F.lit("/"))), r"^\./", ""), F.lit(""))


def workspace_key(url: Column) -> Column:
    """host/owner/name in lower case from any spelling of a remote; `local:` keys stay; null if empty."""
    bare = F.trim(url)
    scheme = F.rlike(bare, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://"))
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?", "")
    scp = F.regexp_replace(bare, r"^(?:[^@/\s]+@)([^:/\s]+):(?!//)(.+)$", "$1/$2")
    out = F.when(scheme, rest).otherwise(scp)
    out = F.regexp_replace(out, r"^([^/:]*):\d+(?=/|$)", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"^/+|/+$", ""), r"\.git$", "")
    return F.when(F.startswith(bare, F.lit("local:")), F.lower(bare)).otherwise(F.nullif(F.lower(out), F.lit("")))


def slug_plain(path: Column) -> Column:
    """Lower case, runs of other characters as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(path), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def slug_kept(path: Column) -> Column:
    """Each colon, slash or back slash as a dash; case kept."""
    return F.translate(path, ":\\/", "---")


def stub_id(doc: Column, most: int = 191) -> Column:
    """`stub-` and the document id; a longer one is cut and closed by 12 digits of its SHA-1."""
    whole = F.concat(F.lit("stub-"), doc)
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.substring(whole, 1, most - 13), F.lit("-"), F.substring(F.sha1(doc), 1, 12)))


def idle_label(hours: Column) -> Column:
    return F.when(hours < 48, F.concat(hours.cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d")))


def strip_front_matter(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)\A---\r?\n.*?\n---\r?\n?", ""))


def markdown_body(text: Column, most: int = 6000) -> Column:
    body = strip_front_matter(text)
    return F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("\n\n...(truncated)"))).otherwise(body)


def prompt_line(text: Column) -> Column:
    """The first line of a prompt without leading @file references and tags; null if nothing is left."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^(?:@\S+\s*)+", ""), r"<[^>]+>", ""))
    return F.nullif(F.trim(F.element_at(F.split(bare, "\n"), 1)), F.lit(""))


#: Fixed value: openings that say nothing about a conversation.
_GREETING = r"(?i)^(?:来[，,]?\s*)?(?:先)?(?:来)?\s*(?:onboard(?:ing)?|开始|你好|hi|hello)\s*(?:一下)?(?:的|先|吧)?[\s!！。.]*$"


def conversation_title(hint: Column, prompts: Column, ref: Column) -> Column:
    """The host's title, else the first prompt line (a greeting is paired with the second), else the reference's start."""
    first, second = F.get(prompts, F.lit(0)), F.get(prompts, F.lit(1))
    pair = F.concat(first, F.lit(" → "), F.substring(second, 1, 80))
    derived = F.when(F.rlike(first, F.lit(_GREETING)) & second.isNotNull(), pair).otherwise(F.substring(first, 1, 100))
    fallback = F.coalesce(F.nullif(F.substring(ref, 1, 8), F.lit("")), F.lit("Untitled conversation"))
    return F.coalesce(F.nullif(F.substring(F.trim(hint), 1, 100), F.lit("")), derived, fallback)


def summarise_tool_input(pairs: Column, value_most: int = 200, total_most: int = 600) -> Column:
    """`k=v` of (key, value) structs in document order; long values say how much is cut; cut, then redacted; null if empty."""

    def value(v: Column) -> Column:
        cut = lambda x: F.concat(F.substring(x, 1, value_most), F.lit("… (+"), (F.length(x) - value_most).cast("string"), F.lit(" chars)"))
        flat = F.trim(F.regexp_replace(F.coalesce(v, F.lit("")), r"(?U)\s+", " "))
        return once(flat, lambda x: F.when(F.length(x) > value_most, cut(x)).otherwise(x))

    whole = F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), value(p["value"]))), ", ")
    return once(once(once(whole, lambda x: clip(x, total_most)), lambda x: redact(x)["text"]), lambda x: F.nullif(x, F.lit("")))


#: Folders and files whose names alone are sensitive.
_SENSITIVE_FOLDER = r"(?i)(^|/)(secrets?|credentials?|\.ssh|\.gnupg)/"
_SENSITIVE_FILE = r"(?i)(^|/)(\.env(\..+)?|credentials?\.(json|ya?ml)|id_rsa|id_ed25519|[^/]+\.(pem|key|p12|pfx|keystore|jks))$"


def is_sensitive_path(path: Column) -> Column:
    return F.rlike(path, F.lit(_SENSITIVE_FOLDER)) | F.rlike(path, F.lit(_SENSITIVE_FILE))


def vcs_summary(status: Column, most: int = 40) -> Column:
    """A porcelain status as its first lines; sensitive paths (of renames the new one) and lines beyond are only counted."""
    none = F.array().cast("array<string>")
    lines = F.filter(F.split(F.coalesce(status, F.lit("")), r"\r\n|\n|\r"), lambda x: F.trim(x) != "")

    def path(x: Column) -> Column:
        name = F.trim(F.when(F.length(x) > 3, F.substr(x, F.lit(4))).otherwise(x))
        return F.trim(F.trim(F.element_at(F.split(name, " -> "), -1)), F.lit('"'))

    def summary(lines_: Column, shown: Column) -> Column:
        hidden, more = F.size(lines_) - F.size(shown), F.size(shown) - most
        over = F.when(more > 0, F.array(F.concat(F.lit("... and "), more.cast("string"), F.lit(" more changed path(s)")))).otherwise(none)
        held = F.when(hidden > 0, F.array(F.concat(F.lit("["), hidden.cast("string"), F.lit(" sensitive path(s) withheld]")))).otherwise(none)
        return F.array_join(F.concat(F.slice(shown, 1, most), over, held), "\n")

    open_ = lambda x: once(path(x), lambda p: ~is_sensitive_path(p))
    return once(lines, lambda all_: once(F.filter(all_, open_), lambda shown: summary(all_, shown)))


def embedding_of_json(text: Column) -> Column:
    """A JSON array as a vector; what can't be read is null."""
    parsed = F.from_json(text, "array<float>")
    return F.when(F.size(parsed) > 0, parsed)
