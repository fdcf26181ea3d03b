"""Column expressions for text: coercion, normalisation, tokens, n-grams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space beyond ASCII: ideographic space, no-break space.
WIDE_SPACE = r"[\s　 ]+"
#: Fixed value: what accented Latin letters lose in folding, each pair aligned.
_FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyy"


def to_number(c: Column, kind: str = "double", default: object = None) -> Column:
    """A number, or the default where the text is none (ANSI casts would fail)."""
    out = c.cast("string").try_cast("double")
    if kind != "double":
        out = out.try_cast(kind)
    return out if default is None else F.coalesce(out, F.lit(default).cast(kind))


def to_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of white space, wide ones too, as one space; none at the ends."""
    return F.btrim(F.regexp_replace(c, WIDE_SPACE, " "))


def join_lists(a: Column, b: Column) -> Column:
    """`a; b` with repeated separators squeezed and none at the ends."""
    both = F.concat(to_text(a), F.lit("; "), to_text(b))
    return F.btrim(F.regexp_replace(both, r"(;\s*)+", "; "), F.lit("; "))


def to_flag(c: Column) -> Column:
    """Text booleans: true, 1, yes; everything else, null too, is false."""
    return F.coalesce(F.lower(F.btrim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def weighted_text(title: Column, keywords: Column, abstract: Column, sep: str = ". ", title_weight: int = 2, keyword_weight: int = 2) -> Column:
    """Title and keywords repeated by their weights before the abstract, so n-grams see the copies."""
    return F.concat(F.repeat(F.concat(to_text(title), F.lit(sep)), title_weight), F.repeat(F.concat(to_text(keywords), F.lit(sep)), keyword_weight), to_text(abstract))


def fold(c: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(c), _FOLD_FROM, _FOLD_TO)


def words(c: Column) -> Column:
    """Maximal runs of letters, digits and underscore, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def english_tokens(c: Column, low: int = 2, high: int = 40) -> Column:
    """Runs that consist of a-z only and have low to high letters. Other runs are passed over whole, as empty matches: looking
    behind each character takes longer."""
    sign = r"[\p{L}\p{N}_]"
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(f"([a-z]{{{low},{high}}}+)(?!{sign})|{sign}+"), F.lit(1)), lambda w: w != "")


def plain_tokens(c: Column) -> Column:
    """Runs of two word characters or more, accents folded."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def hyphen_tokens(c: Column) -> Column:
    """Words of a-z with inner hyphens, accents folded: a letter, then letters or hyphens, ending on a letter."""
    return F.regexp_extract_all(fold(c), F.lit(r"[a-z][a-z\-]*[a-z]"), F.lit(0))


def cjk_tokens(c: Column) -> Column:
    """Admissible tokens of segmented text: two characters or more, CJK or alphanumeric, not all digits."""
    parts = F.split(squeeze(c), " ")
    return F.filter(parts, lambda w: (F.length(w) >= 2) & F.rlike(w, F.lit(r"^[一-龥A-Za-z0-9]+$")) & ~F.rlike(w, F.lit(r"^[0-9]+$")))


def max_match_pattern(dictionary: list[str]) -> str:
    """A pattern that cuts text by forward maximum match: the longest word of the dictionary at each place, else a run of
    letters and digits of the Latin alphabet, else one character that is no space."""
    known = sorted({w for w in dictionary if w}, key=lambda w: (-len(w), w))
    plain = lambda w: "".join(c if c.isalnum() or c == "_" else f"\\{c}" for c in w)
    return "|".join([*map(plain, known), "[A-Za-z0-9]+", r"[^ \t\r\n]"])


def max_match_tokens(c: Column, dictionary: list[str]) -> Column:
    """Words of text without spaces, by forward maximum match over the caller's dictionary (user words included)."""
    return F.regexp_extract_all(c, F.lit(max_match_pattern(dictionary)), F.lit(0))


def without(tokens: Column, stopwords: list[str]) -> Column:
    """Tokens that are not stopwords."""
    if not stopwords:
        return tokens
    return F.filter(tokens, lambda w: ~w.isin(*sorted(set(stopwords))))


def let(value: Column, f) -> Column:
    """f of a value that is computed once: inside a lambda an expression would be computed anew for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ngrams(tokens: Column, n: int, sep: str = " ") -> Column:
    """n-grams of neighbouring tokens; none if there are fewer than n. The tokens are laid beside themselves, shifted, once:
    a slice for each n-gram would copy all tokens each time, and work would grow with the square of a text's length."""

    def spans(k: Column) -> Column:
        beside = F.arrays_zip(*[F.slice(k, i + 1, F.greatest(F.size(k) - n + 1, F.lit(0))).alias(f"t{i}") for i in range(n)])
        return F.when(F.size(k) >= n, F.transform(beside, lambda x: F.concat_ws(sep, *[x[f"t{i}"] for i in range(n)]))).otherwise(F.array().cast("array<string>"))

    return let(tokens, spans)


def char_ngrams(c: Column, n: int) -> Column:
    """n-grams of characters, spaces and signs included, lower-cased; characters are cut apart once, so the work is
    in proportion to the length."""
    return all_char_ngrams(c, [n])


def all_char_ngrams(c: Column, sizes: list[int]) -> Column:
    """char_ngrams() of several sizes in one array."""
    return let(F.filter(F.split(F.lower(c), ""), lambda x: x != ""), lambda k: F.concat(*[ngrams(k, n, "") for n in sizes]))


def occurrences(text: Column, phrase: Column) -> Column:
    """How often the phrase occurs in the text without overlaps; 0 for an empty phrase."""
    gone = F.length(text) - F.length(F.replace(text, phrase, F.lit("")))
    return F.when(F.length(phrase) == 0, F.lit(0)).otherwise((gone / F.length(phrase)).cast("int"))


def keyword_phrases(c: Column, stopwords: list[str] = ()) -> Column:
    """The set of keyword phrases, in order: split on ; , |, keep a-z 0-9 hyphen and space, squeeze, three characters or
    more, no stopwords."""
    parts = F.split(fold(to_text(c)), "[;,|]")
    clean = F.transform(parts, lambda p: F.btrim(F.regexp_replace(F.regexp_replace(p, r"[^a-z0-9\- ]", " "), " +", " ")))
    kept = F.filter(clean, lambda p: F.length(p) >= 3)
    return F.array_sort(F.array_distinct(without(kept, list(stopwords))))
