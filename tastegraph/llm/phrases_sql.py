"""SQL of the phrase collocations."""

COLLOCATIONS_SQL = """WITH texts AS (SELECT coalesce(lang,'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece,'[\\x20\\x09]+'), lambda x: x<>'') AS w FROM texts),
places AS (SELECT lang, w, unnest(range(1, len(w)+1)) AS i FROM pieces),
runs AS (SELECT lang, w, i, unnest(range(1, least(5, len(w)-i+1)+1)) AS size FROM places),
f AS (SELECT lang, size, array_to_string(w[i:i+size-1],' ') AS phrase, count(*) AS a FROM runs GROUP BY ALL HAVING count(*)>=100),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY 1),
cand AS (SELECT f.*, string_split(phrase,' ') AS w FROM f WHERE size>=2),
kept AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE b.lang=c.lang AND b.size=c.size+1 AND b.a=c.a AND (array_to_string(b.w[1:c.size],' ')=c.phrase OR array_to_string(b.w[2:c.size+1],' ')=c.phrase))),
cuts AS (SELECT lang, phrase, a, w, unnest(range(1, size)) AS k FROM kept),
scored AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n, k, (1000::HUGEINT*c.a*n)//(x.a::HUGEINT*y.a) AS score FROM cuts c JOIN total USING (lang) JOIN f x ON x.lang=c.lang AND x.phrase=array_to_string(c.w[1:c.k],' ') JOIN f y ON y.lang=c.lang AND y.phrase=array_to_string(c.w[c.k+1:],' ')),
weakest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored) WHERE place=1)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM weakest) WHERE rank<=2000"""
