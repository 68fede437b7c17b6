"""Column functions on text and token arrays. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from echoframe.functions import constants as C

ColumnLike = Column | str


def _col(value: ColumnLike) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Catalyst may inline a column into the lambda that mentions it, and would
    then evaluate it once per array element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fill(template: str, placeholder: str, value: Column) -> Column:
    """Constant template with every ``placeholder`` replaced by ``value``.

    Concatenating the constant parts never rescans inserted text, so braces
    inside the value are safe.
    """
    parts = template.split(placeholder)
    pieces: list[Column] = [F.lit(parts[0])]
    for part in parts[1:]:
        pieces += [value, F.lit(part)]
    return F.concat(*pieces)


# ---- tokens -----------------------------------------------------------------


def tokenize(text: ColumnLike, max_length: int | None = C.MAX_LENGTH) -> Column:
    """Split into tokens that keep their leading blanks; joining them gives the text back.

    Blanks after the last token are dropped. Right-truncated to ``max_length``.
    """
    tokens = F.regexp_extract_all(_col(text), F.lit(C.TOKEN_PATTERN), F.lit(0))
    return tokens if max_length is None else F.slice(tokens, 1, max_length)


def candidate_positions(
    tokens: ColumnLike, min_position: int = C.MIN_POSITION, specials: Sequence[str] = ()
) -> Column:
    """0-based positions from ``min_position`` on whose token is not special."""

    def among(toks: Column) -> Column:
        size = F.size(toks)
        every = F.when(
            size > min_position, F.sequence(F.lit(min_position).cast("bigint"), (size - 1).cast("bigint"))
        ).otherwise(F.array().cast("array<bigint>"))
        if not specials:
            return every
        return F.filter(every, lambda p: ~F.get(toks, p.cast("int")).isin(list(specials)))

    return let(_col(tokens), among)


def prefix_text(tokens: ColumnLike, position: Column, specials: Sequence[str] = ()) -> Column:
    """Text of the tokens up to and including the 0-based ``position``."""
    head = F.slice(_col(tokens), F.lit(1), (position + 1).cast("int"))
    if specials:
        head = F.filter(head, lambda t: ~t.isin(list(specials)))
    return F.array_join(head, "")


PREFIX_ROWS = "array<struct<n_raw_tokens:bigint,detokenized_text_truncated:string>>"


def prefixes(tokens: Column, positions: Column, specials: Sequence[str] = ()) -> Column:
    """Token count and prefix text at each of the ascending 0-based ``positions``.

    Every prefix extends the one before it, so the tokens are joined once per
    document and not once per position.
    """
    start = F.struct(
        F.lit(0).cast("bigint").alias("done"), F.lit("").alias("text"), F.array().cast(PREFIX_ROWS).alias("rows")
    )

    def extend(acc: Column, p: Column) -> Column:
        piece = F.slice(tokens, (acc["done"] + 1).cast("int"), (p + 1 - acc["done"]).cast("int"))
        if specials:
            piece = F.filter(piece, lambda t: ~t.isin(list(specials)))
        return let(
            F.concat(acc["text"], F.array_join(piece, "")),
            lambda text: F.struct(
                (p + 1).alias("done"),
                text.alias("text"),
                F.array_append(
                    acc["rows"],
                    F.struct((p + 1).alias("n_raw_tokens"), text.alias("detokenized_text_truncated")),
                ).alias("rows"),
            ),
        )

    return F.aggregate(positions, start, extend, lambda acc: acc["rows"])


def tail_matches(tokens: ColumnLike, suffix: Sequence[str]) -> Column:
    """True when the last tokens equal ``suffix``."""
    tokens = _col(tokens)
    k = len(suffix)
    return (F.size(tokens) >= k) & (
        F.slice(tokens, F.greatest(F.size(tokens) - k + 1, F.lit(1)), F.lit(k))
        == F.array(*[F.lit(s) for s in suffix])
    )


def template_suffix_tokens(template: str, placeholder: str) -> list[str]:
    """Tokens after the placeholder without the first, which may merge with inserted text."""
    import re

    _, found, tail = template.rpartition(placeholder)
    stable = re.sub(C.TOKEN_PATTERN, "", tail, count=1).rstrip() if found else ""
    if not stable:
        raise ValueError(f"{template!r} needs {placeholder} and two tokens after it")
    return re.findall(C.TOKEN_PATTERN, stable)


def response_slice(ids: ColumnLike, prompt_len: ColumnLike) -> Column:
    """Generated part of a sequence: everything after the prompt."""
    ids, start = _col(ids), _col(prompt_len)
    return F.slice(ids, (start + 1).cast("int"), F.greatest(F.size(ids) - start, F.lit(0)).cast("int"))


def mask_prompt_labels(ids: ColumnLike, prompt_len: ColumnLike) -> Column:
    """Training labels: ids with the prompt part set to the ignored label."""
    ignored = F.lit(C.IGNORED_LABEL).cast("bigint")
    return let(_col(prompt_len), lambda start: F.transform(_col(ids), lambda x, i: F.when(i < start, ignored).otherwise(x)))


# ---- answers ----------------------------------------------------------------


def strip(text: ColumnLike) -> Column:
    """Drop white space of any script at both ends."""
    return F.btrim(_col(text), F.lit(C.WHITESPACE))


def first_match(text: ColumnLike, pattern: str) -> Column:
    """Group 1 of the first match, NULL without one (``regexp_extract`` would give '')."""
    return F.try_element_at(F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(1)), F.lit(1))


def extract_answer(raw: ColumnLike, pattern: str = C.ANALYSIS_PATTERN) -> Column:
    """Content of the tagged answer, NULL when a tag is missing."""
    return first_match(raw, pattern)


def clean_list_markers(content: ColumnLike) -> Column:
    """One feature per line: drop bullets and numbering, unwrap leading bold, join by a blank line."""
    lines = F.transform(
        F.split(_col(content), "\n", -1),
        lambda line: F.btrim(
            strip(
                F.regexp_replace(
                    F.regexp_replace(line, C.LIST_MARKER_PATTERN, ""), C.LEADING_BOLD_PATTERN, "$1 "
                )
            ),
            F.lit("*_"),
        ),
    )
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n\n")


def feature_count(explanation: ColumnLike) -> Column:
    """Number of features: blank-line separators plus one."""
    return F.size(F.split(_col(explanation), "\n\n", -1)).cast("bigint")


def has_enough_features(explanation: ColumnLike, min_features: int = C.MIN_FEATURES) -> Column:
    """False for NULL as well, so it can be used as a filter and as a flag."""
    return F.coalesce(feature_count(explanation) >= min_features, F.lit(False))


def drop_reason(
    raw: ColumnLike, extracted: ColumnLike, min_features: int = C.MIN_FEATURES
) -> Column:
    """Why a label attempt is dropped, NULL when it is kept."""
    raw, extracted = _col(raw), _col(extracted)
    count = feature_count(extracted)
    too_few = _fill(C.DROP_TOO_FEW.replace("{minimum}", str(min_features)), "{count}", count.cast("string"))
    return (
        F.when(raw.isNull(), F.lit(C.DROP_NO_COMPLETION))
        .when(extracted.isNull(), F.lit(C.DROP_NO_MATCH))
        .when(count < min_features, too_few)
    )


def wrap_explanation(text: ColumnLike) -> Column:
    return F.concat(F.lit(C.EXPLANATION_OPEN + "\n"), _col(text), F.lit("\n" + C.EXPLANATION_CLOSE))


def extract_explanation(response: ColumnLike) -> Column:
    """Trimmed text of the first explanation, NULL when there is none."""
    return strip(first_match(response, C.EXPLANATION_PATTERN))


def explanation_or_raw(response: ColumnLike) -> Column:
    """Explanation without tags; the whole trimmed text when there are no tags."""
    return F.coalesce(extract_explanation(response), strip(response))


def has_explanation(response: ColumnLike) -> Column:
    return F.coalesce(F.rlike(_col(response), F.lit(C.EXPLANATION_PATTERN)), F.lit(False))


# ---- prompts ----------------------------------------------------------------


def instruction_prompt(text: ColumnLike, template: str = C.INSTRUCTION_TEMPLATE) -> Column:
    if "{text}" not in template:
        raise ValueError("the instruction template must contain {text}")
    return _fill(template, "{text}", _col(text))


def critic_prompt(explanation: ColumnLike, template: str = C.CRITIC_TEMPLATE) -> Column:
    if "{explanation}" not in template:
        raise ValueError("the critic template must contain {explanation}")
    return _fill(template, "{explanation}", _col(explanation))


def actor_prompt(template: str = C.ACTOR_TEMPLATE) -> Column:
    """Constant one-message chat prompt that still holds the placeholder."""
    if "{injection_char}" not in template:
        raise ValueError("the actor template must contain {injection_char}")
    content = template.replace("{injection_char}", C.INJECT_PLACEHOLDER)
    return F.array(F.struct(F.lit("user").alias("role"), F.lit(content).alias("content")))


def swap_placeholder(prompt: ColumnLike, marker: str) -> Column:
    """Replace the placeholder by the marker character in every message."""
    return F.transform(
        _col(prompt),
        lambda m: F.struct(
            m["role"].alias("role"),
            F.replace(m["content"], F.lit(C.INJECT_PLACEHOLDER), F.lit(marker)).alias("content"),
        ),
    )


def render_chat(prompt: ColumnLike, add_generation_prompt: bool = True) -> Column:
    """Messages as text with role tags, ready for a response to be appended."""
    body = F.array_join(
        F.transform(_col(prompt), lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n"))),
        "",
    )
    return F.concat(body, F.lit("<|assistant|>\n")) if add_generation_prompt else body


# ---- keys and previews ------------------------------------------------------


def text_key(text: ColumnLike) -> Column:
    """Label-cache key: sha256 of the text."""
    return F.sha2(_col(text), 256)


def preview(text: ColumnLike, chars: int = C.PREVIEW_CHARS) -> Column:
    return F.substring(_col(text), 1, chars)


def tail(text: ColumnLike, chars: int = C.TAIL_CHARS) -> Column:
    return F.right(_col(text), F.lit(chars))
