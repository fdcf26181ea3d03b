"""DuckDB SQL for the catalogue, written apart from the Spark operators so that each checks the other."""

from __future__ import annotations

from ..operators.lemmas import ENDINGS, IRREGULAR
from .queries import LABEL_WORDS, MARKERS, PHRASES, PRIORITIES, SEEDS, SEGMENTS, SPLIT, STOPWORDS, STRONG, WEAK

ORACLE: dict[str, str] = {}


def lst(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0"


SPACE = r"[ \t\n\r\f　 ]".encode().decode("unicode_escape")
FOLD = "translate(lower({0}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


ART = """art AS (
  SELECT doc_id, lang, source, text, split_part(text, chr(10), 1) AS title,
         CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS abstract,
         doc_id % 8 + 2018 AS year, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars END AS cites
  FROM documents)"""


def tokens(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{2,40}}'))"


def plain(x: str) -> str:
    return rf"list_filter(regexp_extract_all({FOLD.format(x)}, '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) >= 2)"


def no_stops(x: str) -> str:
    return f"list_filter({x}, lambda w: NOT list_contains({lst(STOPWORDS)}, w))"


def grams(x: str, n: int) -> str:
    return f"CASE WHEN len({x}) >= {n} THEN list_transform(range(1, len({x}) - {n} + 2), lambda i: array_to_string({x}[i:i + {n - 1}], ' ')) ELSE [] END"


TOK = f"tok AS (SELECT doc_id, lang, {tokens('text')} AS k FROM documents)"
CON = f"con AS (SELECT doc_id, lang, doc_id % 6 + 2020 AS year, {no_stops(tokens('text'))} AS k FROM documents)"
DTM = "dtm AS (SELECT doc_id, lang, year, term, count(*) AS tf FROM (SELECT doc_id, lang, year, unnest(k) AS term FROM con) GROUP BY ALL)"
NDOCS = "nd AS (SELECT lang, count(*) AS n_docs FROM documents GROUP BY lang)"

# cleaning

ORACLE["clean_articles"] = f"""WITH {ART}, c AS (
  SELECT doc_id, {squeeze('title')} AS title, {squeeze('abstract')} AS abstract, year, coalesce(cites, 0) AS cites FROM art)
SELECT doc_id, title, md5(abstract) AS abstract_md5, CAST(year AS INTEGER) AS year, {r6('cites')} AS citations
FROM c WHERE year BETWEEN 2020 AND 2025 AND title <> '' AND abstract <> ''"""

ORACLE["reject_rows"] = f"""WITH {ART}, c AS (
  SELECT CASE WHEN {squeeze('abstract')} = '' THEN 'missing_abstract' WHEN {squeeze('title')} = '' OR {squeeze('source')} = '' THEN 'incomplete_metadata'
              WHEN year NOT BETWEEN 2020 AND 2025 THEN 'year_out_of_range' ELSE 'kept' END AS reason, coalesce(cites, 0) AS cites FROM art)
SELECT reason, count(*) AS n, CAST(sum(cites) AS BIGINT) AS citations FROM c GROUP BY reason"""

ORACLE["dedup_exact"] = "SELECT DISTINCT md5(text) AS text_md5, lang, source FROM documents"

ORACLE["dup_key_diagnostic"] = f"""WITH {ART}, c AS (SELECT doc_id, count(*) OVER (PARTITION BY lang, title) AS copies FROM art)
SELECT doc_id, copies FROM c WHERE copies > 1"""

_hits = lambda words: " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in words)
ORACLE["relevance_filter"] = f"""SELECT doc_id, lang FROM documents
WHERE lang <> 'en' OR ({_hits(STRONG)}) >= 1 OR (({_hits(MARKERS)}) = 0 AND ({_hits(WEAK)}) >= 3)"""

ORACLE["kv_blocks"] = """SELECT CAST(0 AS INTEGER) AS block, lower(n_name) AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation
UNION ALL SELECT 1, 'second: ' || n_name, NULL FROM nation"""

_phr = f"""{ART}, ph AS (
  SELECT doc_id, unnest(list_distinct(list_filter(list_transform(string_split_regex({FOLD.format('title')}, '[;,|]'),
    lambda p: trim(regexp_replace(regexp_replace(p, '[^a-z0-9\\- ]', ' ', 'g'), ' +', ' ', 'g'))),
    lambda p: length(p) >= 3 AND NOT list_contains({lst(STOPWORDS)}, p)))) AS phrase FROM art)"""
ORACLE["keyword_phrases"] = f"WITH {_phr} SELECT doc_id, phrase FROM ph"
ORACLE["keyword_matrix"] = f"""WITH {_phr}, f AS (SELECT phrase FROM ph GROUP BY phrase HAVING count(DISTINCT doc_id) >= 3)
SELECT DISTINCT doc_id, phrase AS term, CAST(1 AS BIGINT) AS tf FROM ph SEMI JOIN f USING (phrase)"""

ORACLE["label_remap"] = """SELECT CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE lang END AS lang, count(*) AS n
FROM documents GROUP BY 1"""

# terms

_count = "SELECT term, count(*) AS freq FROM (SELECT unnest(k) AS term FROM {0}) GROUP BY term"
ORACLE["token_counts"] = f"WITH {TOK} {_count.format('tok')}"

_wt = f"""{ART}, wt AS (SELECT term, CAST(sum(w) AS BIGINT) AS freq FROM (
  SELECT 2 AS w, unnest({tokens('title')}) AS term FROM art UNION ALL SELECT 1, unnest({tokens('abstract')}) FROM art) GROUP BY term)"""
ORACLE["weighted_token_counts"] = f"WITH {_wt} SELECT * FROM wt"


def lemma(terms: str, counts: str) -> str:
    """Tables l0 to l2 from terms(term): as nouns, then as verbs, over a lexicon of the words counted five times or more."""
    rules = ", ".join(f"('{pos}', {i}, '{end}', '{put}')" for pos, all_ in ENDINGS.items() for i, (end, put) in enumerate(all_, 1))
    odd = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in IRREGULAR)
    out = f"rule(pos, i, e, put) AS (VALUES {rules}), odd(form, w, pos) AS (VALUES {odd}), lx AS (SELECT term AS w FROM {counts} WHERE freq >= 5), l0 AS (SELECT DISTINCT term, term AS lemma FROM {terms})"
    for k, pos in enumerate("nv"):
        stem = "left(lemma, length(lemma) - length(e))"
        out += f""", c{k} AS (SELECT term, lemma AS w, 1 AS turn, 0 AS place FROM l{k} UNION ALL SELECT term, w, 0, -1 FROM l{k} JOIN odd ON form = lemma AND pos = '{pos}'
UNION ALL SELECT term, {stem} || put, 1, i FROM l{k} JOIN rule ON pos = '{pos}' AND ends_with(lemma, e) AND length(lemma) > length(e)
UNION ALL SELECT term, left({stem}, length({stem}) - 1), 2, 100 FROM l{k} JOIN rule ON pos = '{pos}' AND pos = 'v' AND put = '' AND e IN ('ed', 'ing') AND ends_with(lemma, e) AND length(lemma) > length(e) + 1
  AND right({stem}, 1) = left(right({stem}, 2), 1) AND NOT contains('aeiou', right({stem}, 1))),
l{k + 1} AS (SELECT l.term, coalesce(b.w, l.lemma) AS lemma FROM l{k} l LEFT JOIN (SELECT term, arg_min(w, (turn, length(w), place, w)) AS w FROM c{k} JOIN lx USING (w) GROUP BY term) b USING (term))"""
    return out


ORACLE["lemma_counts"] = f"WITH {TOK}, c AS ({_count.format('tok')}), {lemma('c', 'c')} SELECT lemma AS term, CAST(sum(freq) AS BIGINT) AS freq FROM c JOIN l2 USING (term) GROUP BY 1"

ORACLE["doc_freq_bounds"] = f"""WITH {TOK}, x AS (SELECT doc_id, unnest(k) AS term FROM tok)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS freq FROM x GROUP BY term
HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) <= 0.85 * (SELECT count(*) FROM documents)"""

_ftt = f"""{CON}, {DTM}, {NDOCS}, pt AS (SELECT lang, term, CAST(sum(tf) AS BIGINT) AS freq, count(DISTINCT doc_id) AS docs FROM dtm GROUP BY ALL),
rk AS (SELECT *, freq / sum(freq) OVER (PARTITION BY lang) AS share, CAST(row_number() OVER (PARTITION BY lang ORDER BY freq DESC, term) AS INTEGER) AS rank FROM pt),
tt AS (SELECT lang, rank, term, freq, share, docs, docs / n_docs AS coverage FROM rk JOIN nd USING (lang))"""
ORACLE["top_terms_by_group"] = f"WITH {_ftt} SELECT lang, rank, term, freq, {r6('share')} AS share, docs, {r6('coverage')} AS coverage FROM tt WHERE rank <= 20"

ORACLE["char_ngrams"] = "WITH x AS (" + " UNION ALL ".join(
    f"SELECT unnest(list_transform(range(1, length(text) - {n} + 2), lambda i: substr(lower(text), i, {n}))) AS term FROM documents" for n in (2, 3, 4)
) + ") SELECT term, count(*) AS freq FROM x GROUP BY term"

ORACLE["ngrams_doc"] = f"""WITH {CON}, x AS (SELECT doc_id, unnest({grams('k', 2)}) AS term FROM con UNION ALL SELECT doc_id, unnest({grams('k', 3)}) FROM con)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS freq FROM x GROUP BY term HAVING count(DISTINCT doc_id) >= 2"""

ORACLE["ngrams_stream"] = f"""WITH {TOK}, x AS (SELECT doc_id, unnest(k) AS w, unnest(range(1, len(k) + 1)) AS p FROM tok),
y AS (SELECT w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM x WINDOW o AS (ORDER BY doc_id, p))
SELECT w || ' ' || w2 || ' ' || w3 AS term, count(*) AS freq FROM y WHERE w3 IS NOT NULL GROUP BY 1"""

_uni = f"u AS ({_count.format('con')}), tot AS (SELECT CAST(sum(freq) AS DOUBLE) AS N FROM u)"
_gram = lambda n: f"g{n} AS (SELECT term, count(*) AS freq FROM (SELECT unnest({grams('k', n)}) AS term FROM con) GROUP BY term)"
_join = lambda n: " ".join(f"JOIN u u{i} ON u{i}.term = split_part(g.term, ' ', {i + 1})" for i in range(n))
for _n, _name in ((2, "llr_bigrams"), (3, "llr_trigrams")):
    _e = " * ".join(f"CAST(u{i}.freq AS DOUBLE)" for i in range(_n)) + " / N" * (_n - 1)
    ORACLE[_name] = f"""WITH {CON}, {_uni}, {_gram(_n)}, s AS (SELECT g.term, g.freq, CAST(g.freq AS DOUBLE) AS k, {_e} AS e, N FROM g{_n} g {_join(_n)}, tot WHERE g.freq >= 2),
l AS (SELECT term, freq, CASE WHEN N > k AND N > e THEN 2 * (k * ln(k / e) + (N - k) * ln((N - k) / (N - e))) ELSE 0 END AS llr FROM s)
SELECT term, freq, {r6('llr')} AS llr FROM l WHERE llr >= 0.1"""


def cell(o: str, p: str, power: str) -> str:
    return f"CASE WHEN {o} > 0 AND {p} > 0 THEN ({o}) * ln(({o}) * {power} / ({p})) ELSE 0 END"


_bi = f"""{CON}, {_uni}, {_gram(2)}, b AS (SELECT g.term, g.freq, CAST(g.freq AS DOUBLE) AS k, CAST(u0.freq AS DOUBLE) AS a, CAST(u1.freq AS DOUBLE) AS c, N FROM g2 g {_join(2)}, tot WHERE g.freq >= 5),
sc AS (SELECT term, freq, 2 * ({cell('k', 'a * c', 'N')} + {cell('(a - k)', 'a * (N - c)', 'N')} + {cell('(c - k)', '(N - a) * c', 'N')} + {cell('(N - a - c + k)', '(N - a) * (N - c)', 'N')}) AS score FROM b)"""
ORACLE["contingency_llr"] = f"WITH {_bi} SELECT term, freq, {r6('score')} AS score FROM sc"
ORACLE["best_collocations"] = f"WITH {_bi} SELECT term, freq, {r6('score')} AS score FROM sc ORDER BY round(score, 9) DESC, term LIMIT 300"

_gap = "CASE WHEN len(k) >= 3 THEN list_transform(range(1, len(k) - 1), lambda i: k[i] || ' ' || k[i + 2]) ELSE [] END"
_cells3 = [
    ("k", "a*b*c"), ("(ab-k)", "a*b*(N-c)"), ("(ac-k)", "a*(N-b)*c"), ("(bc-k)", "(N-a)*b*c"), ("(a-ab-ac+k)", "a*(N-b)*(N-c)"),
    ("(b-ab-bc+k)", "(N-a)*b*(N-c)"), ("(c-ac-bc+k)", "(N-a)*(N-b)*c"), ("(N-a-b-c+ab+ac+bc-k)", "(N-a)*(N-b)*(N-c)"),
]
ORACLE["contingency_llr_trigrams"] = f"""WITH {CON}, {_uni}, {_gram(2)}, {_gram(3)}, gp AS (SELECT term, count(*) AS freq FROM (SELECT unnest({_gap}) AS term FROM con) GROUP BY term),
w AS (SELECT term, freq, split_part(term, ' ', 1) AS x, split_part(term, ' ', 2) AS y, split_part(term, ' ', 3) AS z FROM g3 WHERE freq >= 3),
j AS (SELECT w.term, w.freq, CAST(w.freq AS DOUBLE) AS k, CAST(ux.freq AS DOUBLE) AS a, CAST(uy.freq AS DOUBLE) AS b, CAST(uz.freq AS DOUBLE) AS c,
  CAST(p.freq AS DOUBLE) AS ab, CAST(q.freq AS DOUBLE) AS bc, CAST(r.freq AS DOUBLE) AS ac, N FROM w JOIN u ux ON ux.term = x JOIN u uy ON uy.term = y JOIN u uz ON uz.term = z
  JOIN g2 p ON p.term = x || ' ' || y JOIN g2 q ON q.term = y || ' ' || z JOIN gp r ON r.term = x || ' ' || z, tot)
SELECT term, freq, {r6('2 * (' + ' + '.join(cell(o, p, 'N * N') for o, p in _cells3) + ')')} AS score FROM j"""

ORACLE["phrase_filter"] = f"""WITH {TOK}, c AS ({_count.format('tok')}), g AS (SELECT term AS g, count(*) AS freq FROM (SELECT unnest({grams('k', 2)}) AS term FROM tok) GROUP BY term),
f AS (SELECT split_part(g, ' ', 1) AS x, split_part(g, ' ', 2) AS y, freq FROM g WHERE g <> 'of the' AND NOT contains(g, 'tion')
  AND NOT (list_contains({lst(STOPWORDS)}, split_part(g, ' ', 1)) AND list_contains({lst(STOPWORDS)}, split_part(g, ' ', 2)))), xy AS (SELECT x AS term FROM f UNION SELECT y FROM f), {lemma('xy', 'c')},
h AS (SELECT a.lemma AS a, b.lemma AS b, freq FROM f JOIN l2 a ON a.term = x JOIN l2 b ON b.term = y)
SELECT a || ' ' || b AS term, CAST(sum(freq) AS BIGINT) AS freq FROM h
WHERE length(a) >= 3 AND length(b) >= 3 AND NOT list_contains({lst(STOPWORDS)}, a) AND NOT list_contains({lst(STOPWORDS)}, b) GROUP BY 1"""


def inclusive(phrases: list[str]) -> str:
    occ = lambda x: f"(length({x}) - length(replace(lower({x}), p, ''))) // length(p)"
    return f"SELECT p AS term, CAST(sum(2 * ({occ('title')}) + {occ('abstract')}) AS BIGINT) AS freq FROM art, (SELECT unnest({lst(phrases)}) AS p) GROUP BY p HAVING sum(2 * ({occ('title')}) + {occ('abstract')}) > 0"


ORACLE["mined_phrase_counts"] = f"""WITH {ART}, {CON}, {_gram(2)}, ph AS (SELECT term AS p FROM g2 WHERE freq >= 20), x AS (SELECT p, 2 * ((length(title) - length(replace(lower(title), p, ''))) // length(p)) + (length(abstract) - length(replace(lower(abstract), p, ''))) // length(p) AS n FROM art, ph)
SELECT p AS term, CAST(sum(n) AS BIGINT) AS freq FROM x GROUP BY p HAVING sum(n) > 0"""
ORACLE["phrase_counts_inclusive"] = f"WITH {ART} {inclusive(PHRASES)}"


def replaced(x: str) -> str:
    out = f"lower({x})"
    for p in sorted(set(PHRASES), key=lambda p: (-len(p), p)):
        out = f"replace({out}, '{p}', '{p.replace(' ', '_')}')"
    return rf"list_filter(regexp_extract_all({out}, '[\p{{L}}\p{{N}}_]+'), lambda w: contains(w, '_'))"


ORACLE["phrase_counts_replaced"] = f"""WITH {ART} SELECT term, CAST(sum(w) AS BIGINT) AS freq FROM (
  SELECT 2 AS w, unnest({replaced('title')}) AS term FROM art UNION ALL SELECT 1, unnest({replaced('abstract')}) FROM art) GROUP BY term"""

ORACLE["hot_terms"] = f"""WITH {_wt}, ph AS ({inclusive([*PHRASES, 'the'])}), b AS (SELECT term, freq, 'word' AS s FROM wt UNION ALL SELECT term, freq, 'phrase' FROM ph)
SELECT term, max(freq) AS freq, CASE WHEN count(DISTINCT s) = 2 THEN 'both' ELSE min(s) END AS source FROM b GROUP BY term HAVING max(freq) >= 3"""

ORACLE["hot_term_leaders"] = f"""WITH {TOK}, c AS ({_count.format('tok')}), f AS (SELECT * FROM c ORDER BY freq DESC, term LIMIT 200)
SELECT term, freq FROM f WHERE NOT list_contains({lst(STOPWORDS)}, term) ORDER BY freq DESC, term LIMIT 10"""

# classification

_seed = "seed(doc_id, idx, field, text) AS (VALUES " + ", ".join(f"({-1 - i}, {i}, '{f}', '{s}')" for i, (f, s) in enumerate(SEEDS)) + ")"
_both = "both_ AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM seed)"


def weights(rows: str) -> str:
    return f"""{_seed}, {_both}, {rows}, tf AS (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY ALL),
st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term ORDER BY cf DESC, term LIMIT 30000),
ra AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM both_)) / (1 + df)) + 1) AS w FROM tf JOIN st USING (term)),
we AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM ra)"""


def classified(rows: str) -> str:
    return f"""{weights(rows)}, dots AS (SELECT d.doc_id, s.idx, sum(d.weight * p.weight) AS score FROM we d JOIN we p USING (term) JOIN seed s ON s.doc_id = p.doc_id WHERE d.doc_id >= 0 GROUP BY ALL),
sc AS (SELECT d.doc_id, s.idx, s.field, round(coalesce(x.score, 0), 9) AS score FROM documents d CROSS JOIN seed s LEFT JOIN dots x ON x.doc_id = d.doc_id AND x.idx = s.idx),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS r, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS nxt FROM sc),
be AS (SELECT doc_id, field AS raw_field, score, score - nxt AS margin FROM rk WHERE r = 1)"""


_plain = f"pl AS (SELECT doc_id, {plain('text')} AS k FROM both_)"
_words = f"{_plain}, x AS (SELECT doc_id, unnest(k) AS term FROM pl UNION ALL SELECT doc_id, unnest({grams('k', 2)}) FROM pl UNION ALL SELECT doc_id, unnest({grams('k', 3)}) FROM pl)"
ORACLE["tfidf_weights"] = f"""WITH {weights(_plain + ', x AS (SELECT doc_id, unnest(k) AS term FROM pl)')}
SELECT doc_id, count(*) AS n_terms, {r6('sum(weight)')} AS total, {r6('max(weight)')} AS top FROM we WHERE doc_id >= 0 GROUP BY doc_id"""

_cls = f"""{classified(_words)}, hr AS (SELECT *, score < 0.015 OR margin < 0.002 AS high FROM be),
cl AS (SELECT doc_id, raw_field, score, margin, CASE WHEN high AND raw_field <> 'Methods' THEN 'Methods' ELSE raw_field END AS field,
  CASE WHEN high AND raw_field <> 'Methods' THEN 'insufficient evidence' WHEN raw_field = 'Methods' THEN 'methods content' ELSE 'clear evidence' END AS basis,
  high AND raw_field <> 'Methods' AS is_ambiguous, false AS needs_review,
  CASE WHEN (high AND raw_field <> 'Methods') OR (NOT high AND (score < 0.020 OR margin < 0.003)) THEN 'Medium' ELSE 'Low' END AS priority,
  score >= 0.020 AND margin >= 0.003 AS is_high_confidence FROM hr)"""
ORACLE["classify_tfidf"] = f"WITH {_cls} SELECT * REPLACE ({r6('score')} AS score, {r6('margin')} AS margin) FROM cl"
ORACLE["stream_classified"] = ORACLE["classify_tfidf"]
ORACLE["classify_legacy_review"] = f"WITH {classified(_words)} SELECT doc_id, raw_field, {r6('score')} AS score, {r6('margin')} AS margin, score < 0.03 OR margin < 0.005 AS needs_review FROM be"
_chars = "x AS (" + " UNION ALL ".join(f"SELECT doc_id, unnest(list_transform(range(1, length(text) - {n} + 2), lambda i: substr(lower(text), i, {n}))) AS term FROM both_" for n in (2, 3, 4)) + ")"
ORACLE["classify_charngram"] = f"WITH {classified(_chars)} SELECT doc_id, raw_field, {r6('score')} AS score, {r6('margin')} AS margin, score < 0.03 OR margin < 0.005 AS needs_review FROM be"
ORACLE["class_distribution"] = f"WITH {_cls} SELECT field, count(*) AS n FROM cl GROUP BY field"
ORACLE["review_priority"] = f"WITH {_cls} SELECT priority, basis, is_ambiguous, count(*) AS n FROM cl GROUP BY ALL"


def normal_p(z: str) -> str:
    """Two-sided tail of a normal: Simpson's rule on 2,000 steps from 0."""
    u = f"least(abs({z}), 10.0)"
    f = f"list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * pow({u} * i / 2000, 2))))"
    return f"greatest(0.0, 1 - sqrt(2 / pi()) * {u} / 6000 * {f})"


def chi2_p(x: str, df: str) -> str:
    """Upper tail of chi-square with an even number of degrees of freedom: a finite series."""
    return f"list_sum(list_transform(range(0, CAST({df} AS BIGINT) // 2), lambda k: exp(-({x}) / 2 + k * ln(({x}) / 2) - lgamma(k + 1))))"


def adjusted(src: str, key: str, by: str = "") -> str:
    """aq: src(key, p) with q by Benjamini and Hochberg."""
    w = f"PARTITION BY {by} " if by else ""
    return f"""ak AS (SELECT *, row_number() OVER ({w}ORDER BY p, {key}) AS ar, count(*) OVER ({w}) AS am FROM {src}),
aq AS (SELECT *, least(min(p * am / ar) OVER ({w}ORDER BY ar DESC ROWS UNBOUNDED PRECEDING), 1.0) AS q FROM ak)"""


def chi2(src: str, row: str, by: str = "", tail: bool = False) -> str:
    """Pearson's test of a zero-filled panel table (by, row, field, n)."""
    p = f"PARTITION BY {by}, " if by else "PARTITION BY "
    alone = f"PARTITION BY {by}" if by else ""
    return f"""e AS (SELECT *, sum(n) OVER ({p}{row}) AS r, sum(n) OVER ({p}field) AS c, sum(n) OVER ({alone}) AS N_ FROM {src}),
f AS (SELECT *, r * c / N_ AS e FROM e WHERE r > 0 AND c > 0),
a AS (SELECT {by + ',' if by else ''} CAST(sum(n) AS BIGINT) AS n, sum((n - e) * (n - e) / e) AS chi2, count(DISTINCT {row}) AS rs, count(DISTINCT field) AS cs, min(e) AS min_expected FROM f {'GROUP BY ' + by if by else ''})
SELECT {by + ',' if by else ''} n, {r6('chi2')} AS chi2, (rs - 1) * (cs - 1) AS df, {r6('sqrt(chi2 / (n * least(rs - 1, cs - 1)))')} AS cramers_v, {r6('min_expected')} AS min_expected{', ' + r6(chi2_p('chi2', '(rs - 1) * (cs - 1)')) + ' AS p' if tail else ''} FROM a"""


def grid(src: str, by: str = "") -> str:
    """A zero-filled panel pn from rows (by, year, field)."""
    b = f"{by}, " if by else ""
    g = f"(SELECT DISTINCT {by} FROM {src}) CROSS JOIN " if by else ""
    return f"""pc AS (SELECT {b}year, field, count(*) AS n FROM {src} GROUP BY ALL),
pn AS (SELECT {b}year, field, coalesce(n, 0) AS n FROM {g}(SELECT DISTINCT year FROM {src}) CROSS JOIN (SELECT DISTINCT field FROM {src}) LEFT JOIN pc USING ({b}year, field))"""


ORACLE["sensitivity_scopes"] = f"""WITH {_cls}, s AS (SELECT 'final' AS scope, doc_id % 6 AS year, field FROM cl UNION ALL SELECT 'raw', doc_id % 6, raw_field FROM cl
UNION ALL SELECT 'high_confidence', doc_id % 6, field FROM cl WHERE is_high_confidence), {grid('s', 'scope')}, {chi2('pn', 'year', 'scope')}"""

_cos = """ex AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings),
pr AS (SELECT label, p, avg(x) AS x FROM ex GROUP BY ALL), prn AS (SELECT label, sqrt(sum(x * x)) AS n FROM pr GROUP BY label), en AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM ex GROUP BY vec_id),
sc AS (SELECT e.vec_id, pr.label, round(CASE WHEN en.n > 0 AND prn.n > 0 THEN sum(e.x * pr.x) / en.n / prn.n ELSE 0 END, 6) AS score FROM ex e JOIN pr USING (p) JOIN en USING (vec_id) JOIN prn ON prn.label = pr.label GROUP BY e.vec_id, pr.label, en.n, prn.n),
rk AS (SELECT *, row_number() OVER o AS r, lead(score) OVER o AS nxt FROM sc WINDOW o AS (PARTITION BY vec_id ORDER BY score DESC, label))"""
ORACLE["classify_embedding"] = f"""WITH {_cos} SELECT vec_id, 'label ' || label AS raw_field, {r6('score')} AS score, {r6('score - nxt')} AS margin,
CASE WHEN score < 0.35 THEN 'methods' ELSE 'label ' || label END AS field FROM rk WHERE r = 1"""
_chunks = r"""dw AS (SELECT doc_id, greatest(1, (len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')) + 255) // 256) AS n FROM documents),
ch AS (SELECT doc_id, unnest(range(0, n)) AS chunk FROM dw)"""
ORACLE["chunk_pool"] = f"""WITH {_chunks}, cv AS (SELECT doc_id, (doc_id * 7 + chunk) % (SELECT count(*) FROM embeddings) AS vec_id FROM ch),
ex AS (SELECT doc_id, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, len(embedding))) AS p FROM cv JOIN embeddings USING (vec_id)),
m AS (SELECT doc_id, p, max(x) AS x FROM ex GROUP BY ALL) SELECT doc_id, CAST(p AS INTEGER) AS pos, {r6('x / sqrt(sum(x * x) OVER (PARTITION BY doc_id))')} AS x FROM m"""

# panels and tests

ORD = "o AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS field, o_custkey % 2 AS grp FROM orders)"
PAN = f"{ORD}, {grid('o')}"
PANG = f"{ORD}, {grid('o', 'grp')}"
ORACLE["panel_counts"] = f"WITH {PAN} SELECT year, field, n FROM pn"
ORACLE["panel_shares"] = f"WITH {PAN}, s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY year) AS BIGINT) AS total FROM pn) SELECT year, field, n, total, {r6('n / total')} AS share FROM s"
ORACLE["overall_shares"] = f"WITH {PAN} SELECT field, CAST(sum(n) AS BIGINT) AS n, {r6('sum(n) * 100.0 / (SELECT sum(n) FROM pn)')} AS percent FROM pn GROUP BY field"
ORACLE["bar_shares"] = f"""WITH {PAN}, b AS (SELECT field, sum(n) * 100.0 / (SELECT sum(n) FROM pn) AS percent FROM pn GROUP BY field)
SELECT CAST(row_number() OVER (ORDER BY coalesce(list_position({lst(PRIORITIES)}, field), 99), field) AS INTEGER) AS place, field, {r6('percent')} AS percent, printf('%.1f', CAST(percent AS DOUBLE)) || '%' AS label FROM b"""
ORACLE["three_panels"] = f"""WITH {PAN}, s AS (SELECT *, 100.0 * n / sum(n) OVER (PARTITION BY year) AS percent FROM pn)
SELECT CAST(list_position(['1-URGENT', '5-LOW', '3-MEDIUM'], field) AS INTEGER) AS panel, field, year, {r6('percent')} AS percent, printf('%.1f', CAST(percent AS DOUBLE)) || '%' AS label FROM s WHERE field IN ('1-URGENT', '5-LOW', '3-MEDIUM')"""
ORACLE["panel_pivot"] = f"WITH {PAN} SELECT year, " + ", ".join(f"CAST(sum(n) FILTER (field LIKE '{i}%') AS BIGINT) AS p{i}" for i in range(1, 6)) + " FROM pn GROUP BY year"
ORACLE["group_annual_shares"] = f"WITH {PANG}, s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY grp, year) AS BIGINT) AS total FROM pn) SELECT grp, year, field, n, total, {r6('CASE WHEN total > 0 THEN n / total END')} AS share FROM s"
ORACLE["pearson_chi2"] = f"WITH {PAN}, {chi2('pn', 'year', tail=True)}"
ORACLE["pooled_pearson"] = f"WITH {PANG}, pp AS (SELECT grp, field, sum(n) AS n FROM pn GROUP BY ALL), {chi2('pp', 'grp')}"


def newton(src: str, keys: str) -> str:
    """Grouped logit fits by 25 Newton steps: cells (keys, t, y, n) to fit(keys, b, se)."""
    u = f"USING ({keys})"
    return f"""st AS (SELECT {keys}, ln(sum(y) / (sum(n) - sum(y))) AS a FROM {src} GROUP BY {keys}),
nw AS (SELECT {keys}, 0 AS it, a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS se FROM st
  UNION ALL
  SELECT {keys}, it + 1, a + (s2 * g0 - s1 * g1) / (s0 * s2 - s1 * s1), b + (s0 * g1 - s1 * g0) / (s0 * s2 - s1 * s1), sqrt(s0 / (s0 * s2 - s1 * s1))
  FROM (SELECT {keys}, it, any_value(a) AS a, any_value(b) AS b, sum(w) AS s0, sum(w * t) AS s1, sum(w * t * t) AS s2, sum(y - n * p) AS g0, sum((y - n * p) * t) AS g1
        FROM (SELECT {keys}, it, a, b, t, y, n, 1 / (1 + exp(-(a + b * t))) AS p, n * (1 / (1 + exp(-(a + b * t)))) * (1 - 1 / (1 + exp(-(a + b * t)))) AS w FROM nw JOIN {src} {u} WHERE it < 25) GROUP BY {keys}, it)),
fit AS (SELECT {keys}, b, se FROM nw WHERE it = 25)"""


_cells = lambda by: f"""tt AS (SELECT *, sum(n) OVER (PARTITION BY {by}year) AS total FROM pn),
ce AS (SELECT {by}field, CAST(year - min(year) OVER ({'PARTITION BY ' + by.rstrip(', ') if by else ''}) AS DOUBLE) AS t, CAST(n AS DOUBLE) AS y, CAST(total AS DOUBLE) AS n FROM tt)"""  # noqa: E731
ORACLE["leave_one_year_out"] = f"""WITH RECURSIVE {PAN}, lo AS (SELECT y.year AS omitted, pn.* FROM pn, (SELECT DISTINCT year FROM pn) y WHERE y.year <> pn.year),
tt AS (SELECT *, sum(n) OVER (PARTITION BY omitted, year) AS total FROM lo),
ce AS (SELECT omitted, field, CAST(year - min(year) OVER (PARTITION BY omitted) AS DOUBLE) AS t, CAST(n AS DOUBLE) AS y, CAST(total AS DOUBLE) AS n FROM tt), {newton('ce', 'omitted, field')}
SELECT omitted, field, {r6('b')} AS beta, {r6('se')} AS se, {r6('exp(b)')} AS odds_ratio FROM fit"""
ORACLE["logit_trend"] = f"""WITH RECURSIVE {PAN}, {_cells('')}, {newton('ce', 'field')}, tp AS (SELECT *, {normal_p('(b / se)')} AS p FROM fit), {adjusted('tp', 'field')}
SELECT field, {r6('b')} AS beta, {r6('se')} AS se, {r6('b / se')} AS z, {r6('p')} AS p, {r6('q')} AS q, {r6('exp(b)')} AS odds_ratio, {r6('exp(b - 1.96 * se)')} AS or_low, {r6('exp(b + 1.96 * se)')} AS or_high, {r6('100 * (exp(b) - 1)')} AS percent_change FROM aq"""
_d = "(y.b - x.b)"
_s = "sqrt(x.se * x.se + y.se * y.se)"
ORACLE["logit_interaction"] = f"""WITH RECURSIVE {PANG}, {_cells('grp, ')}, {newton('ce', 'grp, field')},
ix AS (SELECT field, {_d} AS c, {_s} AS s FROM (SELECT * FROM fit WHERE grp = 0) x JOIN (SELECT * FROM fit WHERE grp = 1) y USING (field)),
tp AS (SELECT *, {normal_p('(c / s)')} AS p FROM ix), {adjusted('tp', 'field')}
SELECT field, {r6('c')} AS coefficient, {r6('s')} AS se, {r6('p')} AS p, {r6('q')} AS q, {r6('exp(c)')} AS ratio, {r6('exp(c - 1.96 * s)')} AS ratio_low, {r6('exp(c + 1.96 * s)')} AS ratio_high FROM aq"""
# saturated designs have closed forms
ORACLE["individual_fits"] = f"""WITH {ORD}, v AS (SELECT design, field, k, count(*) AS c FROM (SELECT 'none' AS design, field, '' AS k FROM o UNION ALL SELECT 'year', field, CAST(year AS VARCHAR) FROM o UNION ALL SELECT 'group and year', field, grp || '/' || year FROM o) GROUP BY ALL),
w AS (SELECT *, sum(c) OVER (PARTITION BY design, k) AS t FROM v), l AS (SELECT design, CAST(sum(c) AS BIGINT) AS n, sum(c * ln(c / t)) AS loglik, (count(DISTINCT k) - 1) * (count(DISTINCT field) - 1) AS df FROM w GROUP BY design),
m AS (SELECT l.*, CASE WHEN design = 'none' THEN 0 ELSE 2 * (loglik - (SELECT loglik FROM l WHERE design = 'none')) END AS lr FROM l)
SELECT design, n, {r6('loglik')} AS loglik, {r6('lr')} AS lr, CAST(df AS INTEGER) AS df, {r6(f"CASE WHEN df = 0 THEN 1 ELSE {chi2_p('lr', 'df')} END")} AS p FROM m"""
ORACLE["saturated_loglik"] = f"WITH {PANG}, s AS (SELECT n, sum(n) OVER (PARTITION BY grp, year) AS t FROM pn) SELECT {r6('sum(n * ln(n / t))')} AS loglik FROM s WHERE n > 0"

_pp = "pp AS (SELECT p_partkey, p_type, u * u AS p FROM (SELECT p_partkey, p_type, CAST('0x' || substr(md5('7|' || p_partkey), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM part))"


def bh(by: str = "") -> str:
    w = f"PARTITION BY {by} " if by else ""
    return f"""k AS (SELECT *, row_number() OVER ({w}ORDER BY p, p_partkey) AS r, count(*) OVER ({w}) AS m FROM pp),
q AS (SELECT *, least(min(p * m / r) OVER ({w}ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 1.0) AS q FROM k)"""


ORACLE["bh_adjust"] = f"WITH {_pp}, {bh()} SELECT p_partkey, {r6('q')} AS q FROM q"
ORACLE["bh_within"] = f"WITH {_pp}, {bh('p_type')} SELECT p_partkey, p_type, {r6('q')} AS q FROM q"
ORACLE["holm_adjust"] = f"""WITH {_pp}, k AS (SELECT *, row_number() OVER (ORDER BY p, p_partkey) AS r, count(*) OVER () AS m FROM pp)
SELECT p_partkey, {r6('max(least((m - r + 1) * p, 1.0)) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING)')} AS holm FROM k"""
ORACLE["bonferroni"] = f"WITH {_pp} SELECT p_partkey, {r6('least(count(*) OVER () * p, 1.0)')} AS bonferroni FROM pp"

_z = "(b / nb - a / na) / sqrt(greatest((a + b) / (na + nb) * (1 - (a + b) / (na + nb)) * (1 / na + 1 / nb), 1e-15))"


def split(src: str, by: str = "", side: int = 2, out: str = "sp") -> str:
    b = f"{by}, " if by else ""
    return f"""{out}_t AS (SELECT *, sum(n) OVER (PARTITION BY {b}year) AS total FROM {src}),
{out}_y AS (SELECT year AS cut, row_number() OVER (ORDER BY year) AS i, count(*) OVER () AS m FROM (SELECT DISTINCT year FROM {src})),
{out}_s AS (SELECT {b}field, cut, CAST(sum(n) FILTER (year <= cut) AS DOUBLE) AS a, CAST(sum(total) FILTER (year <= cut) AS DOUBLE) AS na, CAST(sum(n) FILTER (year > cut) AS DOUBLE) AS b, CAST(sum(total) FILTER (year > cut) AS DOUBLE) AS nb
  FROM {out}_t, {out}_y WHERE i >= {side} AND m - i >= {side} GROUP BY ALL),
{out} AS (SELECT {b}field, cut, a / na AS before, b / nb AS after, b / nb - a / na AS diff, {_z} AS z FROM {out}_s)"""


def window(src: str, by: str = "", out: str = "wi") -> str:
    b = f"{by}, " if by else ""
    inside = "i >= s AND i < s + 2"
    return f"""{out}_y AS (SELECT year, row_number() OVER (ORDER BY year) AS i, count(*) OVER () AS m FROM (SELECT DISTINCT year FROM {src})),
{out}_t AS (SELECT x.*, i, sum(n) OVER (PARTITION BY {b}x.year) AS total FROM {src} x JOIN {out}_y USING (year)),
{out}_s AS (SELECT {b}field, start, CAST(sum(n) FILTER ({inside}) AS DOUBLE) AS a, CAST(sum(total) FILTER ({inside}) AS DOUBLE) AS na, CAST(sum(n) FILTER (NOT ({inside})) AS DOUBLE) AS b, CAST(sum(total) FILTER (NOT ({inside})) AS DOUBLE) AS nb
  FROM {out}_t, (SELECT year AS start, i AS s FROM {out}_y WHERE m - i >= 1) GROUP BY ALL),
{out} AS (SELECT {b}field, start, a / na AS inside, b / nb AS outside, b / nb - a / na AS diff, {_z} AS z FROM {out}_s)"""


_best = lambda src, by, value, place: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by}field ORDER BY round({value}, 9) DESC, {place}) AS k FROM {src}) WHERE k = 1)"
_cut, _win = "cut || '/' || (cut + 1)", "start || '-' || (start + 1)"
_four = lambda a, b: ", ".join(f"{r6(c)} AS {c}" for c in (a, b, "diff", "z"))
ORACLE["change_scan"] = f"WITH {PAN}, {split('pn')} SELECT field, cut, {_four('before', 'after')}, {_cut} AS label FROM {_best('sp', '', 'abs(z)', 'cut')}"
ORACLE["stage_scan"] = f"WITH {PAN}, {split('pn', side=1)} SELECT field, cut, {r6('before')} AS before, {r6('after')} AS after, {r6('diff * 100')} AS diff_pp FROM {_best('sp', '', 'abs(diff)', 'cut')}"
ORACLE["low_window_scan"] = f"WITH {PAN}, {window('pn')} SELECT field, start, {_four('inside', 'outside')}, {_win} AS label FROM {_best('wi', '', 'z', 'start')}"
ORACLE["fixed_split_effects"] = f"WITH {PAN}, {split('pn', side=1)} SELECT field, cut, {_four('before', 'after')} FROM sp WHERE cut = {SPLIT}"
_three = "field IN ('1-URGENT', '5-LOW', '3-MEDIUM')"
ORACLE["key_signals"] = f"""WITH {PANG}, {split('pn', 'grp')}, {window('pn', 'grp')}
SELECT grp, field, 'split' AS signal, {_cut} AS place, {r6('z')} AS value FROM {_best('sp', 'grp, ', 'abs(z)', 'cut')} WHERE {_three}
UNION ALL SELECT grp, field, 'low window', {_win}, {r6('z')} FROM {_best('wi', 'grp, ', 'z', 'start')} WHERE {_three}"""

_start = SPLIT - 3
ORACLE["fixed_window_effects"] = f"WITH {PAN}, {window('pn')} SELECT field, start, {_four('inside', 'outside')} FROM wi WHERE start = {_start}"
_scoped = f"""so AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS raw, o_totalprice AS v FROM orders),
sr AS (SELECT 'final' AS scope, year, CASE WHEN v < 20000 THEN '4-NOT SPECIFIED' ELSE raw END AS field FROM so UNION ALL SELECT 'raw', year, raw FROM so UNION ALL SELECT 'high_confidence', year, raw FROM so WHERE v >= 50000), {grid('sr', 'scope')}"""
_stp = f"{_scoped}, {_cells('scope, ')}, {newton('ce', 'scope, field')}, tp AS (SELECT *, {normal_p('(b / se)')} AS p FROM fit), {adjusted('tp', 'field', 'scope')}"
ORACLE["scope_trends"] = f"WITH RECURSIVE {_stp} SELECT scope, field, {r6('b')} AS beta, {r6('se')} AS se, {r6('b / se')} AS z, {r6('p')} AS p, {r6('q')} AS q, {r6('exp(b)')} AS odds_ratio FROM aq"
_pick = lambda s: ", ".join(f"max(v) FILTER (scope = '{x}') AS {x}" for x in s)
ORACLE["scope_signal_effects"] = f"""WITH RECURSIVE {_stp}, {split('pn', 'scope')}, {window('pn', 'scope')},
sg AS (SELECT 'linear trend' AS signal, scope, {r6('exp(b)')} AS v FROM aq WHERE field = '1-URGENT' UNION ALL SELECT 'change point', scope, {r6('diff * 100')} FROM {_best('sp', 'scope, ', 'abs(z)', 'cut')} WHERE field = '5-LOW'
UNION ALL SELECT 'low window', scope, {r6('diff * 100')} FROM {_best('wi', 'scope, ', 'z', 'start')} WHERE field = '3-MEDIUM')
SELECT signal, {_pick(('final', 'raw', 'high_confidence'))} FROM sg GROUP BY signal"""

# resampling


def permuted(reps: int, seed: int) -> str:
    return f"""{ORD}, rp AS (SELECT unnest(range({reps})) AS rep), pa AS (SELECT rep, field, row_number() OVER (PARTITION BY rep ORDER BY md5('{seed}|' || rep || '|' || o_orderkey), o_orderkey) AS k FROM o, rp),
pb AS (SELECT rep, year, row_number() OVER (PARTITION BY rep ORDER BY o_orderkey) AS k FROM o, rp), sh AS (SELECT rep, year, field FROM pa JOIN pb USING (rep, k)),
nc AS (SELECT rep, year, field, count(*) AS n FROM sh GROUP BY ALL),
nu AS (SELECT rep, year, field, coalesce(n, 0) AS n FROM rp CROSS JOIN (SELECT DISTINCT year FROM o) CROSS JOIN (SELECT DISTINCT field FROM o) LEFT JOIN nc USING (rep, year, field)), {grid('o')}"""


def perm_p(seen: str, null: str, value: str, extra: str = "") -> str:
    return f"""SELECT field, {r6('s.stat')} AS stat, count(*) FILTER (v.stat >= s.stat - 1e-12) AS exceed, count(*) AS reps, {r6('(count(*) FILTER (v.stat >= s.stat - 1e-12) + 1) / (count(*) + 1)')} AS p{extra}
FROM (SELECT field, max(round({value}, 12)) AS stat FROM {seen} GROUP BY field) s JOIN (SELECT rep, field, max(round({value}, 12)) AS stat FROM {null} GROUP BY rep, field) v USING (field) GROUP BY field, s.stat"""


ORACLE["permutation_stage"] = f"WITH {permuted(20, 11)}, {split('pn', side=1, out='ob')}, {split('nu', 'rep', 1, 'nn')} {perm_p('ob', 'nn', 'abs(diff)')}"
ORACLE["permutation_scans"] = f"""WITH {permuted(10_000, 12)}, {split('pn', out='ob')}, {split('nu', 'rep', 2, 'nn')}, {window('pn', out='ow')}, {window('nu', 'rep', 'nw')}
{perm_p('ob', 'nn', 'abs(z)', ", 'split' AS scan")} UNION ALL {perm_p('ow', 'nw', 'z', ", 'window' AS scan")}"""

# concentration


def metrics(src: str, by: str = "") -> str:
    """Concentration metrics me from weights (by, doc_id, lang, term, w)."""
    b = f"{by}, " if by else ""
    return f"""pt AS (SELECT {b}lang, term, sum(w) AS w, count(DISTINCT doc_id) AS df FROM {src} GROUP BY ALL),
vo AS (SELECT {b}count(DISTINCT term) AS v FROM {src} {'GROUP BY ' + by if by else ''}),
rs AS (SELECT *, w / sum(w) OVER (PARTITION BY {b}lang) AS s, row_number() OVER (PARTITION BY {b}lang ORDER BY round(w, 9) DESC, term) AS r FROM pt),
ag AS (SELECT {b}lang, sum(s) FILTER (r <= 10) AS top10_share, sum(s) FILTER (r <= 20) AS top20_share, sum(s * s) AS hhi, -sum(s * ln(s)) AS en, max(df) AS df FROM rs GROUP BY ALL),
me AS (SELECT {b}lang, top10_share, top20_share, hhi, en / ln(v) AS norm_entropy, df / n_docs AS max_coverage FROM ag JOIN nd USING (lang) {'JOIN vo USING (' + by + ')' if by else ', vo'})"""


_M = ("top10_share", "top20_share", "hhi", "norm_entropy", "max_coverage")
_m6 = ", ".join(f"{r6(m)} AS {m}" for m in _M)
ORACLE["concentration_metrics"] = f"WITH {CON}, {DTM}, {NDOCS}, {metrics('(SELECT doc_id, lang, term, CAST(tf AS DOUBLE) AS w FROM dtm)')} SELECT lang, {_m6} FROM me"
_sp = f"""{CON}, {DTM}, {NDOCS}, dt AS (SELECT *, tf / sum(tf) OVER (PARTITION BY doc_id) AS l1 FROM dtm), gs AS (SELECT lang, year, count(DISTINCT doc_id) AS g FROM dtm GROUP BY ALL),
sw AS (SELECT 'frequency' AS spec, doc_id, lang, term, CAST(tf AS DOUBLE) AS w FROM dt UNION ALL SELECT 'presence', doc_id, lang, term, 1.0 FROM dt
  UNION ALL SELECT 'paper', doc_id, lang, term, l1 FROM dt UNION ALL SELECT 'year_paper', doc_id, lang, term, l1 / g FROM dt JOIN gs USING (lang, year)), {metrics('sw', 'spec')}"""
ORACLE["spec_table"] = f"WITH {_sp} SELECT spec, lang, {_m6} FROM me"
_both2 = lambda x: f"list_concat({x}, {grams(x, 2)})"
_nolab = f"list_filter(k, lambda w: NOT list_contains({lst(LABEL_WORDS)}, w))"
_variants = {"full": _both2("k"), "pairs": grams("k", 2), "no_labels": _both2("nl"), "clear": _both2("k")}
ORACLE["spec_table_full"] = f"""WITH {_phr}, {CON}, cn AS (SELECT *, {_nolab} AS nl FROM con), va AS (""" + " UNION ALL ".join(
    f"SELECT '{n}' AS variant, doc_id, lang, year, {e} AS k FROM cn" + (" SEMI JOIN (SELECT doc_id FROM documents WHERE length(text) >= 200) USING (doc_id)" if n == "clear" else "") for n, e in _variants.items()
) + f""" UNION ALL SELECT 'keywords', c.doc_id, c.lang, c.year, coalesce(p, []) FROM cn c LEFT JOIN (SELECT doc_id, list(phrase) AS p FROM ph GROUP BY doc_id) USING (doc_id)),
sz AS (SELECT variant, lang, count(*) AS n_docs FROM va GROUP BY ALL), d0 AS (SELECT variant, doc_id, lang, year, term, count(*) AS tf FROM (SELECT variant, doc_id, lang, year, unnest(k) AS term FROM va) GROUP BY ALL),
kp AS (SELECT variant, term FROM d0 JOIN (SELECT variant, sum(n_docs) AS n FROM sz GROUP BY variant) USING (variant) GROUP BY variant, term, n HAVING count(*) >= 5 AND count(*) <= 0.85 * n),
d1 AS (SELECT *, tf / sum(tf) OVER (PARTITION BY variant, doc_id) AS l1 FROM d0 SEMI JOIN kp USING (variant, term)), gs AS (SELECT variant, lang, year, count(DISTINCT doc_id) AS g FROM d1 GROUP BY ALL),
sw AS (SELECT CASE WHEN variant = 'full' THEN 'frequency' ELSE variant END AS spec, doc_id, lang, term, CAST(tf AS DOUBLE) AS w FROM d1 UNION ALL SELECT 'presence', doc_id, lang, term, 1.0 FROM d1 WHERE variant = 'full'
  UNION ALL SELECT 'paper', doc_id, lang, term, l1 FROM d1 WHERE variant = 'full' UNION ALL SELECT 'year_paper', doc_id, lang, term, l1 / g FROM d1 JOIN gs USING (variant, lang, year) WHERE variant = 'full'),
nd AS (SELECT unnest(CASE WHEN variant = 'full' THEN ['frequency', 'presence', 'paper', 'year_paper'] ELSE [variant] END) AS spec, lang, n_docs FROM sz),
""" + metrics("sw", "spec").replace("JOIN nd USING (lang) JOIN vo", "RIGHT JOIN nd USING (spec, lang) LEFT JOIN vo").replace("df / n_docs AS max_coverage", "df / n_docs AS max_coverage, n_docs, v AS vocabulary") + f"""
SELECT spec, lang, {_m6}, n_docs, CASE WHEN hhi IS NULL THEN NULL ELSE vocabulary END AS vocabulary FROM me"""
ORACLE["pair_robustness"] = f"""WITH {_sp}, lo AS (""" + " UNION ALL ".join(f"SELECT spec, lang, '{m}' AS metric, {m} AS value FROM me" for m in _M) + f"""),
pd AS (SELECT x.spec, x.lang AS a, y.lang AS b, x.metric, x.value AS value_a, y.value AS value_b, CASE WHEN x.metric = 'norm_entropy' THEN -1 ELSE 1 END * round(x.value - y.value, 12) AS adv
  FROM lo x JOIN lo y ON x.spec = y.spec AND x.metric = y.metric AND x.lang < y.lang)
SELECT spec, a, b, metric, {r6('value_a')} AS value_a, {r6('value_b')} AS value_b, {r6('adv')} AS advantage_a, CASE WHEN adv > 0 THEN a WHEN adv < 0 THEN b ELSE 'Tie' END AS winner FROM pd"""
ORACLE["concentration_curve"] = f"""WITH {_ftt} SELECT lang, rank, {r6('sum(freq) OVER (PARTITION BY lang ORDER BY rank ROWS UNBOUNDED PRECEDING) / total')} AS cumulative_share
FROM (SELECT *, sum(freq) OVER (PARTITION BY lang) AS total FROM rk) WHERE rank <= 50"""
ORACLE["largest_coverage"] = f"""WITH {_ftt}, p AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY round(coverage, 9) DESC, term) AS INTEGER) AS place FROM tt WHERE rank <= 30)
SELECT lang, place, term, {r6('coverage')} AS coverage FROM p WHERE place <= 10"""
ORACLE["text_lengths"] = f"""WITH {CON} SELECT lang, count(*) AS docs, {r6('avg(len(k))')} AS mean, {r6('quantile_cont(len(k), 0.25)')} AS q25, {r6('quantile_cont(len(k), 0.5)')} AS median, {r6('quantile_cont(len(k), 0.75)')} AS q75 FROM con GROUP BY lang"""


def share20(labels: str, out: str) -> str:
    """Top-20 shares (rep, lang, v) of documents under labels (rep, doc_id, lang)."""
    return f"""{out}_x AS (SELECT rep, l.lang, term, sum(tf) AS w FROM {labels} l JOIN (SELECT doc_id, term, tf FROM dtm) d USING (doc_id) GROUP BY ALL),
{out}_r AS (SELECT *, w / sum(w) OVER (PARTITION BY rep, lang) AS s, row_number() OVER (PARTITION BY rep, lang ORDER BY w DESC, term) AS r FROM {out}_x),
{out} AS (SELECT rep, lang, sum(s) AS v FROM {out}_r WHERE r <= 20 GROUP BY ALL)"""


_own = "ow AS (SELECT 0 AS rep, doc_id, lang FROM documents)"
_diff = "SELECT rep, round(max(v) FILTER (lang = 'de') - max(v) FILTER (lang = 'es'), 12) AS diff FROM {0} GROUP BY rep"
ORACLE["pair_scan_top20"] = f"""WITH {CON}, {DTM}, {_own}, {share20('ow', 's')}
SELECT x.lang AS a, y.lang AS b, {r6('x.v')} AS va, {r6('y.v')} AS vb, CASE WHEN round(x.v - y.v, 12) > 0 THEN x.lang ELSE y.lang END AS more_concentrated FROM s x JOIN s y ON x.lang < y.lang"""
ORACLE["pair_permutation"] = f"""WITH {CON}, {DTM}, {_own}, rp AS (SELECT unnest(range(8)) AS rep), tw AS (SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'es')),
pk AS (SELECT rep, doc_id, row_number() OVER (PARTITION BY rep ORDER BY md5('21|' || rep || '|' || doc_id), doc_id) AS k FROM tw, rp),
la AS (SELECT rep, doc_id, CASE WHEN k <= (SELECT count(*) FROM tw WHERE lang = 'de') THEN 'de' ELSE 'es' END AS lang FROM pk), {share20('ow', 's')}, {share20('la', 'n')},
d AS (SELECT o.diff, v.diff AS null_diff FROM ({_diff.format('s')}) o, ({_diff.format('n')}) v),
a AS (SELECT diff, avg(null_diff) AS null_mean, (count(*) FILTER (null_diff >= diff - 1e-12) + 1) / (count(*) + 1) AS up, (count(*) FILTER (null_diff <= diff + 1e-12) + 1) / (count(*) + 1) AS low FROM d GROUP BY diff)
SELECT 'de-es' AS pair, {r6('diff')} AS diff, {r6('null_mean')} AS null_mean, {r6('least(1.0, 2 * least(up, low))')} AS p FROM a"""
ORACLE["rarefaction"] = f"""WITH {CON}, {DTM}, rp AS (SELECT unnest(range(8)) AS rep), tw AS (SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'es')),
pk AS (SELECT rep, doc_id, lang, row_number() OVER (PARTITION BY rep, lang ORDER BY md5('31|' || rep || '|' || lang || '|' || doc_id), doc_id) AS k FROM tw, rp),
la AS (SELECT rep, doc_id, lang FROM pk WHERE k <= (SELECT min(c) FROM (SELECT count(*) AS c FROM tw GROUP BY lang))), {share20('la', 'n')}, d AS ({_diff.format('n')})
SELECT 'de-es' AS pair, {r6('quantile_cont(diff, 0.5)')} AS median, {r6('quantile_cont(diff, 0.025)')} AS low, {r6('quantile_cont(diff, 0.975)')} AS high, {r6('avg(CAST(diff > 0 AS DOUBLE))')} AS share_positive FROM d"""

ORACLE["stream_term_counts"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS freq FROM events GROUP BY ALL"

# word lists, segmentation, projections, scopes, sets, orders

ORACLE["word_cloud"] = f"""WITH {CON}, u AS (SELECT term, count(*) AS freq FROM (SELECT unnest(k) AS term FROM con) GROUP BY term HAVING count(*) >= 3 ORDER BY freq DESC, term LIMIT 120)
SELECT term, freq, {r6('freq / (SELECT max(freq) FROM u)')} AS weight FROM u"""
ORACLE["phrase_leaders"] = f"""WITH {CON}, {_gram(2)}, f AS (SELECT * FROM g2 ORDER BY freq DESC, term LIMIT 200)
SELECT term, freq FROM f WHERE NOT contains(term, 'an') ORDER BY freq DESC, term LIMIT 10"""
ORACLE["minimum_frequency"] = f"WITH {CON} SELECT term, count(*) AS freq FROM (SELECT unnest(k) AS term FROM con) GROUP BY term HAVING count(*) >= 10"
ORACLE["hyphen_counts"] = rf"SELECT term, count(*) AS freq FROM (SELECT unnest(regexp_extract_all({FOLD.format('text')}, '[a-z](?:[a-z\-]*)[a-z]')) AS term FROM documents) GROUP BY term"
ORACLE["cjk_counts"] = f"""SELECT term, count(*) AS freq FROM (SELECT unnest(string_split({squeeze('text')}, ' ')) AS term FROM documents)
WHERE length(term) >= 2 AND regexp_full_match(term, '[一-龥A-Za-z0-9]+') AND NOT regexp_full_match(term, '[0-9]+') GROUP BY term"""
_run = "regexp_replace(lower(text), '[^a-z]+', '-', 'g')"
_cut = "|".join(sorted(SEGMENTS, key=lambda w: (-len(w), w))) + "|[A-Za-z0-9]+|[^ ]"
ORACLE["max_match_counts"] = f"SELECT term, count(*) AS freq FROM (SELECT unnest(regexp_extract_all({_run}, '{_cut}')) AS term FROM documents) WHERE length(term) <= 12 GROUP BY term"
ORACLE["registered_segmenter"] = f"SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all({_run}, '{_cut}')) AS word FROM documents) WHERE list_contains({lst(SEGMENTS)}, word) GROUP BY word"
_wtx = "title || '. ' || title || '. ' || coalesce(source, '') || '. ' || coalesce(source, '') || '. ' || abstract"
ORACLE["weighted_text_bigrams"] = f"WITH {ART}, w AS (SELECT {tokens(_wtx)} AS k FROM art) SELECT term, count(*) AS freq FROM (SELECT unnest({grams('k', 2)}) AS term FROM w) GROUP BY term"
_var = {"word": "k", "word_pair": f"list_concat(k, {grams('k', 2)})", "pair": grams("k", 2), "no_label_words": f"list_filter(k, lambda w: NOT list_contains({lst(['english', 'french', 'german', 'spanish', *LABEL_WORDS])}, w))"}
ORACLE["document_term_variants"] = f"WITH {CON}, x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS variant, doc_id, unnest({e}) AS term FROM con" for n, e in _var.items()) + """)
SELECT variant, count(DISTINCT term) AS terms, count(DISTINCT (doc_id, term)) AS cells, count(*) AS tokens FROM x GROUP BY variant"""
ORACLE["renamed_columns"] = "SELECT doc_id, lang AS group_label, source AS journal FROM documents"
ORACLE["joined_lists"] = rf"""SELECT doc_id, trim(regexp_replace(coalesce(CASE WHEN doc_id % 3 <> 0 THEN lang || '; ;' END, '') || '; ' || coalesce(source, ''), '(;\s*)+', '; ', 'g'), '; ') AS labels FROM documents"""
ORACLE["text_flags"] = "SELECT doc_id, doc_id % 6 < 3 AS flag FROM documents"
ORACLE["backfilled_columns"] = "SELECT lang, CAST(NULL AS VARCHAR) AS journal, 0 AS citations, count(*) AS n FROM documents GROUP BY lang"
ORACLE["outside_labels"] = "SELECT DISTINCT lang FROM documents WHERE lang NOT IN ('en', 'fr')"
ORACLE["label_union"] = "SELECT label FROM (SELECT lang AS label FROM documents UNION SELECT source FROM documents) WHERE label IS NOT NULL"
ORACLE["domain_order"] = f"SELECT o_orderpriority AS label, count(*) AS n, CAST(coalesce(list_position({lst(PRIORITIES)}, o_orderpriority) - 1, {len(PRIORITIES)}) AS BIGINT) AS position FROM orders GROUP BY o_orderpriority"
ORACLE["period_shares"] = f"""WITH r AS (SELECT 'all' AS scope, o_orderpriority AS field FROM orders UNION ALL SELECT 'to_1996', o_orderpriority FROM orders WHERE year(o_orderdate) <= 1996),
c AS (SELECT scope, field, count(*) AS n FROM r GROUP BY ALL) SELECT scope, field, n, CAST(sum(n) OVER (PARTITION BY scope) AS BIGINT) AS total, {r6('n / sum(n) OVER (PARTITION BY scope)')} AS share FROM c"""
ORACLE["clear_scope_counts"] = """SELECT 'some' AS "case", 'all' AS scope, lang, count(*) AS n FROM documents GROUP BY lang
UNION ALL SELECT 'some', 'non_ambiguous', lang, count(*) FROM documents WHERE n_chars >= 200 AND EXISTS (SELECT 1 FROM documents WHERE coalesce(n_chars, 0) < 200) GROUP BY lang
UNION ALL SELECT 'none', 'all', lang, count(*) FROM documents GROUP BY lang"""
ORACLE["trend_with_early_share"] = f"""WITH {PANG}, w AS (SELECT grp, field, CAST(sum(n) AS BIGINT) AS n FROM pn GROUP BY ALL)
SELECT grp, field, n, (SELECT CAST(sum(e.n) AS BIGINT) FROM pn e WHERE e.grp = w.grp AND e.field = w.field AND e.year <= 1994 AND e.field <> '5-LOW') AS n_early FROM w"""
ORACLE["by_significance"] = f"""WITH {_pp}, {bh()}, z AS (SELECT p_partkey, p, round(q, 9) AS q FROM q)
SELECT p_partkey, {r6('p')} AS p, {r6('q')} AS q, CAST(row_number() OVER (ORDER BY q, p, p_partkey) AS INTEGER) AS place FROM z"""
