"""Scalar functions on text, paths and scores, as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes: Unicode spaces and the byte order mark.
WHITE = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
WORD = "[a-zà-ÿ0-9]+"


def words(text: Column) -> Column:
    """The lower-cased words that the keyword index holds."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def estimate_tokens(text: Column) -> Column:
    """A quarter token for each ASCII character, two thirds for each CJK one and a third for others, rounded up."""
    ascii_, cjk = F.regexp_count(text, F.lit(r"[\x00-\x7F]")), F.regexp_count(text, F.lit(r"[\x{4E00}-\x{9FFF}]"))
    return F.ceil(F.round(ascii_ / 4 + cjk / 1.5 + (F.length(text) - ascii_ - cjk) / 3, 9)).cast("long")


def count_tokens(text: Column) -> Column:
    """Four UTF-16 code units a token, rounded up."""
    return F.ceil(F.octet_length(F.encode(text, "UTF-16BE")) / 8).cast("long")


def image_tokens(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), F.ceil(width * height / 750)).otherwise(0).cast("long")


def glob_to_regex(glob: str) -> str:
    """* is a run without /, ** anything, **/ any folders or none, ? one character but /; the rest stands for itself."""
    table = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(table.get(p) or re.escape(p) for p in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob)) + "$"


def glob_prefix(glob: str) -> str:
    """What every match starts with; a parquet scan can use it where it can't use a regex."""
    return re.split(r"[*?]", glob, maxsplit=1)[0]


def glob_match(path: Column, glob: str) -> Column:
    hit, prefix = path.rlike(glob_to_regex(glob)), glob_prefix(glob)
    return path.startswith(prefix) & hit if prefix else hit


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def excluded(path: Column) -> Column:
    """The host's own folders, and what lies in them."""
    return path.rlike(r"^\.(?:obsidian|trash)(?:/|$)")


def under(path: Column, folder: str) -> Column:
    folder = folder[:-1] if folder.endswith("/") else folder
    return (path == folder) | path.startswith(folder + "/") if folder else F.lit(True)


def normalize_path(path: Column) -> Column:
    """Without leading and doubled slashes and without . segments."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    return F.array_join(parts, "/")


def path_error(path: Column) -> Column:
    """Why a path is refused, or null."""
    plain = normalize_path(path)
    return (
        F.when(path.isNull() | (trim(path) == ""), "empty").when(path.rlike(r"^[A-Za-z]:"), "absolute")
        .when(F.exists(F.split(path, r"[/\\]"), lambda p: p == ".."), "traversal").when(excluded(plain), "excluded")
    )


def fences_closed(text: Column) -> Column:
    return F.regexp_count(text, F.lit("```")) % 2 == 0


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substr(text, F.lit(1), F.lit(n)), F.lit("…"))).otherwise(text)


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences; of an empty needle none."""
    return F.when(needle == "", 0).otherwise((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("long")


def replace_once(text: Column, old: Column, new: Column) -> Column:
    """Literal replacement of the first occurrence."""
    at = F.instr(text, old)
    return F.when(at == 0, text).otherwise(F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(old))))


def band(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "mid").otherwise("low")


def similarity_label(score: Column) -> Column:
    return F.when(score > 0.8, "similar").when(score > 0.5, "related").otherwise("different")


def similarity_bar(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score + 1) / 2))


def percentage(used: Column, most: Column) -> Column:
    return F.when(most > 0, F.round(used * 100 / most)).otherwise(0).cast("long")


def usage_band(percent: Column) -> Column:
    return F.when(percent >= 95, "danger").when(percent >= 80, "warning").otherwise("normal")


def parse_rewrites(answer: Column, most: int = 2) -> Column:
    """Lines of a model's answer without numbering and blanks, the first `most`."""
    lines = F.transform(F.split(F.coalesce(answer, F.lit("")), "\n"), lambda x: trim(F.regexp_replace(trim(x), r"^\d+\.\s*", "")))
    return F.slice(F.filter(lines, lambda x: x != ""), 1, most)


def intent(answer: Column) -> Column:
    said = F.lower(trim(F.coalesce(answer, F.lit(""))))
    return F.when(F.contains(said, F.lit("rag")), "rag").when(F.contains(said, F.lit("direct")), "direct").otherwise("rag")


def error_type(message: Column, status: Column | None = None, code: Column | None = None) -> Column:
    """Ordered rules on an error's message, HTTP status and code. The parts of messages are fixed values."""
    said = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *parts: said.rlike("|".join(map(re.escape, parts)))
    is_ = lambda n: F.coalesce(status == n, F.lit(False)) if status is not None else F.lit(False)
    not_ready = F.coalesce(code == "INDEX_NOT_READY", F.lit(False)) if code is not None else F.lit(False)
    return (
        F.when(not_ready | has("尚未加载", "未就绪"), "model").when(is_(401) | has("apikey", "api key", "unauthorized", "401"), "config")
        .when(is_(404) | has("404") | (has("model") & has("not found")), "config").when(has("network", "fetch", "econnrefused", "enotfound", "timeout"), "network")
        .when(has("embedding", "tokenizer", "onnx", "wasm", "模型"), "model").when(is_(400) | has("invalid", "bad request", "400"), "runtime")
        .when(is_(429) | has("rate limit", "429"), "network").otherwise("unknown")
    )


def mermaid_blocks(html: Column) -> Column:
    """Sources of mermaid code blocks in rendered HTML, as they stand, with entities resolved one kind after the other."""
    found = F.regexp_extract_all(html, F.lit(r'(?s)<code[^>]*class="[^"]*language-mermaid[^"]*"[^>]*>(.*?)</code>'), 1)

    def plain(x: Column) -> Column:
        for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
            x = F.replace(x, F.lit(entity), F.lit(character))
        return x

    return F.transform(found, plain)


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def tool_label(name: Column, argument: Column, is_path: Column) -> Column:
    """A tool's name and its argument: a path as it is, the root as a slash; other text with 30 characters at most."""
    path = F.when(argument.isin(".", "./"), "/").otherwise(argument)
    short = F.when(F.length(argument) > 30, F.concat(F.substr(argument, F.lit(1), F.lit(30)), F.lit("…"))).otherwise(argument)
    return F.when(argument.isNull() | (argument == ""), name).otherwise(F.concat(name, F.lit(" "), F.when(is_path, path).otherwise(short)))


def attachment_error(mime: Column, size: Column, ordinal: Column) -> Column:
    """Checked in this order: type, size of 5 MB, four items."""
    return F.when(~mime.isin("image/png", "image/jpeg", "image/gif", "image/webp"), "type").when(size > 5 * 1024 * 1024, "size").when(ordinal > 4, "count")


def transfer_eta(done: Column, total: Column, seconds: Column) -> Column:
    """(bytes a second, seconds left) with zeros where nothing can be said."""
    speed = F.when(seconds > 0, done / seconds).otherwise(0.0)
    return F.struct(speed.alias("speed"), F.when(speed > 0, (total - done) / speed).otherwise(0.0).alias("eta"))


def enough_disk(free: Column, needed: Column) -> Column:
    return free >= needed * 1.2


def status_tone(indexing: Column, error: Column, configured: Column, thinking: Column) -> Column:
    return F.when(indexing, "indexing").when(error, "error").when(~configured, "unconfigured").when(thinking, "thinking").otherwise("ready")


def index_row(state: Column, scanned: Column, total: Column, pending: Column, path: Column, reason: Column, docs: Column) -> Column:
    """(index, detail, docs): the row that shows an index's state."""
    name = F.when(state == "Unloaded", "idle").otherwise(F.lower(state))
    detail = (
        F.when(state == "Scanning", F.concat_ws("/", scanned.cast("string"), total.cast("string"))).when(state == "Queueing", F.concat(pending.cast("string"), F.lit(" 待索引")))
        .when(state == "Processing", path).when(state == "Paused", F.concat(pending.cast("string"), F.lit(" 待处理"))).when(state == "Failed", reason)
    )
    return F.struct(name.alias("index"), detail.alias("detail"), F.when(state == "Ready", docs).alias("docs"))


def model_row(state: Column, progress: Column, reason: Column, before: Column, after: Column) -> Column:
    """(model, detail): the row that shows a model's state; progress is from 0 to 1."""
    name = F.when(state == "NotStarted", "idle").when(state == "Switching", "checking").otherwise(F.lower(state))
    percent = F.concat(F.floor(progress * 100 + 0.5).cast("long").cast("string"), F.lit("%"))
    detail = F.when(state == "Downloading", percent).when(state == "Failed", reason).when(state == "Switching", F.concat_ws(" → ", before, after))
    return F.struct(name.alias("model"), detail.alias("detail"))


def tool_path(args: Column) -> Column:
    """The string at $.path of JSON arguments, else null."""
    value = F.try_variant_get(F.try_parse_json(args), "$.path", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(F.try_parse_json(args), "$.path", "string"))


def parse_args(args: Column) -> Column:
    """JSON text, or {"raw": ...} around what can't be parsed."""
    return F.when(F.try_parse_json(args).isNotNull(), args).otherwise(F.to_json(F.struct(args.alias("raw"))))


def chat_error(code: Column, message: Column) -> Column:
    """The kind of an error in a chat: a cancelled answer is no failure of the settings or the network."""
    return F.when(code == "CANCELLED", "runtime").otherwise(error_type(message, None, code))


def command_matches(typed: Column, name: Column) -> Column:
    """Whether a command's name starts with what was typed: a slash and no space, in either case."""
    return typed.startswith("/") & ~F.contains(typed, F.lit(" ")) & F.startswith(F.lower(name), F.lower(typed))


def merge_settings(defaults: Column, saved: Column, dropped: tuple[str, ...] = ()) -> Column:
    """Maps of settings: saved ones count before defaults, and dropped names go."""
    kept = F.map_filter(defaults, lambda k, _: ~F.array_contains(F.map_keys(F.coalesce(saved, F.create_map().cast("map<string,string>"))), k))
    every = F.map_concat(kept, F.coalesce(saved, F.create_map().cast("map<string,string>")))
    return F.map_filter(every, lambda k, _: ~k.isin(*dropped)) if dropped else every


def diagnostic_k(k: Column) -> Column:
    """Neighbours asked for: five unless given, at least 1 and at most 50."""
    return F.least(F.greatest(F.coalesce(k, F.lit(5)), F.lit(1)), F.lit(50))


def strip_accents(text: Column) -> Column:
    """Letters of the Latin-1 and Latin Extended-A blocks that are a base letter with an accent lose it."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x180)]
    pairs = [(a, b[0]) for a, b in pairs if len(b) == 2]
    return F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
