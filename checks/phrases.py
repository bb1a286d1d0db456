"""SQL of the key phrases."""

from __future__ import annotations

from corpusmill.functions.keyphrases import STOP_WORDS, TOKEN


def keyphrases_sql(text: str, source: str, key: str, top: int = 6, max_n: int = 3, pool: int | None = None) -> str:
    """CTEs of the same phrases, `best` (key, rank, phrase, score), in the SQL of the oracle."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    ahead = [f"lead({c}, {k}) OVER w AS {c}{k}" for k in range(1, max_n) for c in ("s", "r", "x", "w")]
    lengths = [f"SELECT {key}, round(({' + '.join(['x', *(f'x{k}' for k in range(1, n))])}) / sqrt({n}.0::DOUBLE), 6) AS score, "
               f"{' || chr(32) || '.join(['w', *(f'w{k}' for k in range(1, n))])} AS phrase FROM ahead"
               + (f" WHERE s{n - 1} = s AND r{n - 1} = r" if n > 1 else "") for n in range(1, max_n + 1)]
    best = "phrases" if pool is None else \
        f"(SELECT * FROM phrases QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY score DESC, phrase) <= {pool})"
    return rf"""plain AS (SELECT {key}, array_to_string(list_transform(regexp_extract_all(lower({text}), '{TOKEN}'), lambda t:
    CASE WHEN t IN ('.', '!', '?', chr(10)) THEN '.' WHEN length(t) < 2 OR t IN ({stops}) OR regexp_matches(t, '^[0-9_]+$') THEN '|' ELSE t END), ' ') AS t
    FROM {source}),
sents AS (SELECT {key}, unnest(list) AS sentence, generate_subscripts(list, 1) AS s FROM (SELECT {key}, string_split(t, '.') AS list FROM plain)),
runs AS (SELECT {key}, s, unnest(list) AS run, generate_subscripts(list, 1) AS r FROM (SELECT {key}, s, string_split(sentence, '|') AS list FROM sents)),
wordlists AS (SELECT {key}, s, r, list_filter(string_split(run, ' '), lambda w: w <> '') AS list FROM runs),
recs AS (SELECT {key}, s, r, unnest(list) AS w, generate_subscripts(list, 1) AS j, len(list) AS len FROM wordlists),
weights AS (SELECT {key}, w, sum(least(len, {max_n})) / count(*) * ln(count(*) + 1.0::DOUBLE) * sqrt(count(DISTINCT s)::DOUBLE) AS x FROM recs GROUP BY {key}, w),
ahead AS (SELECT {key}, s, r, x, recs.w, {', '.join(a.replace('lead(w,', 'lead(recs.w,') for a in ahead)} FROM recs JOIN weights USING ({key}, w)
          WINDOW w AS (PARTITION BY {key} ORDER BY s, r, j)),
phrases AS (SELECT DISTINCT {key}, score, phrase FROM ({' UNION ALL '.join(lengths)})),
pool AS (SELECT {key}, list({{'phrase': phrase, 'score': score}} ORDER BY score DESC, phrase) AS p
         FROM {best} GROUP BY {key}),
chosen AS (SELECT {key}, list_reduce(list_transform(p, lambda x: [x]), lambda kept, x: CASE WHEN len(kept) >= {top} OR len(list_filter(kept, lambda k:
    contains(' ' || k.phrase || ' ', ' ' || x[1].phrase || ' ') OR contains(' ' || x[1].phrase || ' ', ' ' || k.phrase || ' '))) > 0
    THEN kept ELSE list_concat(kept, x) END) AS c FROM pool),
best AS (SELECT {key}, unnest(c).phrase AS phrase, unnest(c).score AS score, generate_subscripts(c, 1) AS rank FROM chosen)"""
