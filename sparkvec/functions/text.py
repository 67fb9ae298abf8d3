"""Text normalisation and id-sequence expressions that stay inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points that cleaning deletes, white space, and ideographs that stand alone.
REMOVED = (
    r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{600}-\x{605}\x{61C}\x{6DD}\x{70F}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}"
    r"\x{2060}-\x{2064}\x{2066}-\x{206F}\x{E000}-\x{F8FF}\x{FEFF}\x{FFF9}-\x{FFFB}\x{FFFD}\x{110BD}\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}"
    r"\x{E0001}\x{E0020}-\x{E007F}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"
)
IDEOGRAPH = r"([\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B81F}\x{2B920}-\x{2CEAF}\x{2F800}-\x{2FA1F}])"
#: Basic tokens of ASCII text: every punctuation mark, and runs of the rest.
BASIC_ASCII = r"[!-/:-@\[-`{-~]|[^\s!-/:-@\[-`{-~]+"
#: The same for the JVM, whose named class of ASCII punctuation is several times as fast as the union of its ranges.
BASIC_ASCII_JVM = r"\p{Punct}|[^\s\p{Punct}]+"
BASIC = r"[\p{Punct}\p{P}]|[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\p{Punct}\p{P}]+"
#: Tokens of the older byte-pair models: punctuation marks, single characters beyond ASCII, runs of the rest.
LEGACY = r"[!-/:-@\[-`{-~]|[^\x{0}-\x{7F}]|[0-9A-Za-z\x{7F}]+"
LEGACY_JVM = r"\p{Punct}|\P{ASCII}|[\p{Alnum}\x{7F}]+"
META = "▁"


def _folds() -> tuple[str, str]:
    """Latin-1 letters that decompose to an ASCII letter, and that letter in lower case; dotted and dotless i, long s."""
    found = {chr(c): unicodedata.normalize("NFD", chr(c))[0].lower() for c in range(0xC0, 0x100)}
    pairs = {c: b for c, b in found.items() if b.isascii()} | {"\u0130": "i", "\u0131": "i", "\u017f": "s"}
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _folds()


def ascii_lower(text: Column | str) -> Column:
    return F.translate(text, UPPER, LOWER)


def clean_text(text: Column | str) -> Column:
    return F.regexp_replace(text, REMOVED, "")


def isolate_ideographs(text: Column | str) -> Column:
    return F.regexp_replace(text, IDEOGRAPH, " $1 ")


def basic_tokenize(text: Column | str, ascii_only: bool = False) -> Column:
    """Words and punctuation marks of a cleaned, lower-cased text."""
    whole = clean_text(text) if ascii_only else isolate_ideographs(clean_text(text))
    return F.regexp_extract_all(F.lower(whole), F.lit(BASIC_ASCII_JVM if ascii_only else BASIC), F.lit(0))


def legacy_tokenize(text: Column | str) -> Column:
    """Words of the older byte-pair models, after their folding of case and Latin-1 accents."""
    folded = F.translate(text, UPPER + FOLD_FROM, LOWER + FOLD_TO)
    return F.regexp_extract_all(folded, F.lit(LEGACY_JVM), F.lit(0))


def metaspace(text: Column | str, prepend: bool = True) -> Column:
    """Pieces that each begin with the mark that stands for a space."""
    marked = F.replace(text if isinstance(text, Column) else F.col(text), F.lit(" "), F.lit(META))
    if prepend:
        marked = F.when(F.startswith(marked, F.lit(META)) | (marked == ""), marked).otherwise(F.concat(F.lit(META), marked))
    return F.filter(F.split(marked, f"(?={META})"), lambda p: p != "")


def unigram_normalize(text: Column | str, steps: list[tuple]) -> Column:
    """Apply steps in order: ("replace", old, new), ("collapse", least run, new), ("prepend", what), ("strip", left, right)."""
    out = F.col(text) if isinstance(text, str) else text
    for name, *args in steps:
        if name == "replace":
            out = F.replace(out, F.lit(args[0]), F.lit(args[1]))
        elif name == "collapse":
            out = F.regexp_replace(out, f" {{{args[0]},}}", args[1])
        elif name == "prepend":
            out = F.when(out == "", out).otherwise(F.concat(F.lit(args[0]), out))
        elif name == "strip":
            pattern = "|".join(p for p, on in ((r"^\s+", args[0]), (r"\s+$", args[1])) if on)
            out = F.regexp_replace(out, pattern, "") if pattern else out
        else:
            raise ValueError(f"unknown step {name!r}")
    return out


def encode_single(ids: Column | str, cls: int, sep: int, max_length: int) -> Column:
    """[cls] ids [sep], cut to ``max_length`` with [sep] last."""
    if max_length < 2:
        raise ValueError("max_length must leave room for both marks")
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.concat(F.array(F.lit(cls)), F.slice(ids, 1, max_length - 2), F.array(F.lit(sep)))


def pair_lengths(na: Column, nb: Column, budget: int, strategy: str = "longest_first") -> tuple[Column, Column]:
    """How many ids of each side stay. longest_first shortens the longer side one by one, b on ties, in closed form."""
    over = na + nb > budget
    if strategy == "longest_first":
        kept_b = F.least(nb, F.greatest(F.lit(budget) - na, F.lit(budget // 2)))
        kept_a = F.least(na, F.lit(budget) - kept_b)
    elif strategy == "only_first":
        kept_a, kept_b = F.greatest(F.lit(0), F.lit(budget) - nb), nb
    elif strategy == "only_second":
        kept_a, kept_b = na, F.greatest(F.lit(0), F.lit(budget) - na)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return F.when(over, kept_a).otherwise(na), F.when(over, kept_b).otherwise(nb)


def encode_pair(a: Column | str, b: Column | str, cls: int, sep: int, max_length: int, strategy: str = "longest_first") -> tuple[Column, Column]:
    """(ids, type ids) of ``[cls] a [sep] b [sep]``."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    ka, kb = pair_lengths(F.size(a), F.size(b), max_length - 3, strategy)
    ids = F.concat(F.array(F.lit(cls)), F.slice(a, F.lit(1), ka), F.array(F.lit(sep)), F.slice(b, F.lit(1), kb), F.array(F.lit(sep)))
    return ids, F.concat(F.array_repeat(F.lit(0), ka + 2), F.array_repeat(F.lit(1), kb + 1))


def pad_batch(df: DataFrame, ids: str, batch: list[str], pad: int = 0) -> DataFrame:
    """Adds ``padded`` and ``mask``: ids up to the longest of the batch, and 1 for ids, 0 for padding."""
    longest = F.max(F.size(ids)).over(W.partitionBy(*batch))
    sized = df.withColumn("_room", longest - F.size(ids))
    return sized.withColumn("padded", F.concat(ids, F.array_repeat(F.lit(pad), F.col("_room").cast("int")))).withColumn(
        "mask", F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.col("_room").cast("int")))
    ).drop("_room")


def special_token(explicit: Column, surface: Column, usual: Column) -> Column:
    """Id of a special token: the explicit one, else that of its surface form, else the usual one, else 0."""
    return F.coalesce(explicit, surface, usual, F.lit(0))
