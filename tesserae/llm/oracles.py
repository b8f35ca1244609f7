"""DuckDB SQL for the queries of this subpackage that SQL can express, and the pieces that the pipeline's SQL shares."""

from __future__ import annotations

from . import chat, importance, mixing, sharding

_MD5 = "('0x' || substr(md5({}), 1, 15))::BIGINT"


def shard_ctes(n_shards: int = sharding.N_SHARDS, m: int = sharding.TABLE_SIZE) -> str:
    """CTEs ending in filled(slot, shard): shards take turns until every slot is claimed."""
    return f"""
prefs AS (SELECT i, {_MD5.format("'offset:' || i::VARCHAR")} % {m} AS off, {_MD5.format("'skip:' || i::VARCHAR")} % {m - 1} + 1 AS skip FROM range({n_shards}) t(i)),
setup AS (SELECT list(off ORDER BY i) AS offs, list(skip ORDER BY i) AS skips FROM prefs),
turns(turn, shard, slot, taken, nexts) AS (
  SELECT -1::BIGINT, -1::BIGINT, -1::BIGINT, list_transform(range({m}), lambda x: false), list_transform(range({n_shards}), lambda x: 0::BIGINT)
  UNION ALL
  SELECT turn, shard, slot,
         list_concat(list_concat(taken[:slot], [true]), taken[slot + 2:]),
         list_concat(list_concat(nexts[:shard], [step + 1]), nexts[shard + 2:])
  FROM (SELECT *, (offs[shard + 1] + step * skips[shard + 1]) % {m} AS slot
        FROM (SELECT turn + 1 AS turn, (turn + 1) % {n_shards} AS shard, taken, nexts, offs, skips,
                     nexts[(turn + 1) % {n_shards} + 1] - 1
                     + list_position(list_transform(range(nexts[(turn + 1) % {n_shards} + 1], {m}),
                         lambda j: taken[(offs[(turn + 1) % {n_shards} + 1] + j * skips[(turn + 1) % {n_shards} + 1]) % {m} + 1]), false) AS step
              FROM turns, setup WHERE turn < {m - 1})) x),
filled AS (SELECT slot::INT AS slot, shard::INT AS shard FROM turns WHERE turn >= 0)"""


def slot_sql(key: str, m: int = sharding.TABLE_SIZE) -> str:
    return f"({_MD5.format(f'coalesce({key}::VARCHAR, {chr(39) * 2})')} % {m})::INT"


def mix_ctes(docs: str) -> str:
    """CTEs over docs (doc_id, source, text) ending in mixed (doc_id, size, source_size, target, taken, first_shard)."""
    b, k, p = mixing.BLOCK, mixing.SHARD_SLOTS, mixing.PRIME
    draw = lambda what: _MD5.format(f"concat_ws('|', '{what}', rank::VARCHAR, epoch::VARCHAR, r::VARCHAR)")
    return f"""
m_sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, coalesce('s' || source, 'n') AS skey FROM {docs}),
m_docs AS (SELECT *, sum(size) OVER (PARTITION BY skey ORDER BY doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - size AS start FROM m_sized),
m_src AS (SELECT skey, min(source) AS source, sum(size)::BIGINT AS source_size FROM m_sized GROUP BY skey),
m_rank AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM m_src),
m_cap AS (SELECT *, [{', '.join(map(str, mixing.WEIGHTS))}][((rank - 1) % {len(mixing.WEIGHTS)} + 1)::INT]::BIGINT AS weight, source_size * {mixing.MAX_REPEAT} AS cap FROM m_rank),
m_ratio AS (SELECT *, cap::DOUBLE / weight AS ratio FROM m_cap),
m_level AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * {mixing.SHARE} - (sum(cap) OVER (ORDER BY ratio, rank ROWS UNBOUNDED PRECEDING) - cap)::DOUBLE)
            / (sum(weight) OVER () - sum(weight) OVER (ORDER BY ratio, rank ROWS UNBOUNDED PRECEDING) + weight)::DOUBLE AS level FROM m_ratio),
m_fit AS (SELECT *, (SELECT level FROM m_level WHERE level <= ratio ORDER BY ratio, rank LIMIT 1) AS fit FROM m_level),
m_words AS (SELECT *, least(cap::DOUBLE, fit * weight) AS target, floor(least(cap::DOUBLE, fit * weight) + 0.5)::BIGINT AS words FROM m_fit),
m_pass AS (SELECT *, (source_size + {b - 1}) // {b} AS n, words // source_size AS passes, words % source_size AS rest,
           source_size - ((source_size + {b - 1}) // {b} - 1) * {b} AS tail FROM m_words WHERE source_size > 0),
m_epochs AS (SELECT skey, rank, n, passes, unnest(range(passes + 1)) AS epoch FROM m_pass),
m_keys AS (SELECT *, {draw('k')} % n AS k, {draw('a')} % {p - 1} + 1 AS a, {draw('b')} % {p} AS b FROM m_epochs, range(1, {mixing.ROUNDS + 1}) t(r)),
m_perm AS (
  WITH RECURSIVE walk(skey, epoch, n, place, x, r) AS (
    SELECT skey, epoch, n, unnest(range(n)) AS place, unnest(range(n)) AS x, 1 FROM m_epochs
    UNION ALL
    SELECT w.skey, w.epoch, w.n, place,
           CASE WHEN ((greatest(x, (k.k - x + w.n) % w.n) % {p}) * k.a + k.b) % {p} % 2 = 1 THEN (k.k - x + w.n) % w.n ELSE x END, w.r + 1
    FROM walk w JOIN m_keys k ON k.skey = w.skey AND k.epoch = w.epoch AND k.r = w.r WHERE w.r <= {mixing.ROUNDS})
  SELECT skey, epoch, place, x AS block FROM walk WHERE r = {mixing.ROUNDS + 1}),
m_tail AS (SELECT p.*, q.place AS tail_at FROM m_pass p JOIN m_perm q ON q.skey = p.skey AND q.epoch = p.passes AND q.block = p.n - 1),
m_last AS (SELECT *, CASE WHEN rest <= tail_at * {b} THEN (rest + {b - 1}) // {b} WHEN rest <= tail_at * {b} + tail THEN tail_at + 1 ELSE (rest + {b} - tail + {b - 1}) // {b} END AS last_slots FROM m_tail),
m_plan AS (SELECT *, rest + CASE WHEN last_slots - 1 > tail_at THEN {b} - tail ELSE 0 END - (last_slots - 1) * {b} AS last_words, passes * n + last_slots AS slots FROM m_last),
m_n AS (SELECT greatest(1, (sum(slots) + {k - 1}) // {k})::BIGINT AS n_shards FROM m_plan),
m_thrown AS (SELECT skey, {_MD5.format("concat_ws('|', 'shard', rank::VARCHAR, i::VARCHAR)")} % n_shards AS shard FROM (SELECT skey, rank, unnest(range(slots)) AS i FROM m_plan), m_n),
m_slots AS (SELECT skey, shard, row_number() OVER (PARTITION BY skey ORDER BY shard) - 1 AS i FROM m_thrown),
m_used AS (SELECT s.skey, s.shard, q.block, CASE WHEN q.epoch = p.passes AND q.place = p.last_slots - 1 THEN p.last_words ELSE {b} END AS cut
           FROM m_slots s JOIN m_plan p USING (skey) JOIN m_perm q ON q.skey = s.skey AND q.epoch = s.i // p.n AND q.place = s.i % p.n),
m_piece AS (SELECT *, unnest(range(start // {b}, (start + size - 1) // {b} + 1)) AS block FROM (SELECT * FROM m_docs WHERE size > 0)),
m_got AS (SELECT e.skey, e.start, u.shard, greatest(0, least(least({b}, e.start + e.size - e.block * {b}), u.cut) - greatest(0, e.start - e.block * {b})) AS got
          FROM m_piece e JOIN m_used u ON u.skey = e.skey AND u.block = e.block),
m_taken AS (SELECT skey, start, sum(got)::BIGINT AS taken, min(shard) FILTER (WHERE got > 0) AS first_shard FROM m_got GROUP BY ALL),
mixed AS (SELECT d.doc_id, d.source, d.size, coalesce(w.source_size, 0) AS source_size, coalesce(w.target, 0.0) AS target,
                 CASE WHEN d.size > 0 THEN coalesce(t.taken, 0) ELSE 0 END::BIGINT AS taken, CASE WHEN d.size > 0 THEN t.first_shard END::BIGINT AS first_shard
          FROM m_docs d LEFT JOIN m_words w USING (skey) LEFT JOIN m_taken t ON t.skey = d.skey AND t.start = d.start AND d.size > 0)"""


OP1 = f"WITH RECURSIVE {shard_ctes()}\nSELECT d.doc_id, f.slot, f.shard FROM documents d JOIN filled f ON f.slot = {slot_sql('d.doc_id')}"
OP8 = f"WITH {mix_ctes('documents')}\nSELECT doc_id, size, source_size, target, taken, first_shard FROM mixed"


def op11_sql(b: int = importance.BUCKETS, seed: int = importance.SEED, percent: int = importance.PERCENT, least: int = importance.LEAST_WORDS) -> str:
    """Single words only. The checksum is taken bit by bit, once for each different word."""
    words = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    bits = "flatten(list_transform(range(octet_length(encode(w))), lambda i: list_transform(range(8), lambda k: (('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT >> k) & 1)))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({words.format('text')}, []) AS words FROM documents),
q AS (SELECT unnest(coalesce({words.format('text')}, [])) AS w FROM benchmark),
e AS (SELECT r, unnest(words) AS w FROM d),
v AS (SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda c, bit: xor(c >> 1, 3988292384 * (xor(c, bit) & 1))), 4294967295) % {b} AS bucket
      FROM (SELECT w FROM e UNION SELECT w FROM q)),
s AS (SELECT bucket, count(*) AS n FROM e JOIN v USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM q JOIN v USING (w) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {b})::DOUBLE
                                 / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {b})::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
w AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM e JOIN v USING (w) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT d.r, doc_id, len(words) AS n_words, coalesce(w.n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_words) AS rank, count(*) OVER () AS n FROM x WHERE n_words >= {least})
SELECT doc_id, n_words::BIGINT AS n_words, n_features, weight, score::BIGINT AS score, CASE WHEN rank <= {percent} * n // 100 THEN rank END AS rank FROM x LEFT JOIN k USING (r)"""


OP11 = op11_sql()

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
m AS (SELECT doc_id, part, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
             + 4 * (100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(least < doc_id, false)::INT AS mask FROM w),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
             list_sum([0] || list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k::INT]) - 65)))::INT AS earlier FROM o, range(1, 6) t(step)),
r AS (SELECT part, filter_order, step::INT AS step, bit,
             sum(CASE WHEN mask & (bit | earlier) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r"""


def op12_sql(budget: int = chat.BUDGET, history: int = chat.HISTORY) -> str:
    """Windows by lists of prefix sums, for conversations that are one segment."""
    escaped = r"regexp_replace({}, '([<\[])(\\*)(/?(?:s>|(?:INST|SYS|ROLE|TEXT)\]))', '\1\\\2\3', 'g')"
    return rf"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 2 AS size,
             length({escaped.format("text")}) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 4 WHEN 'system' THEN 11 ELSE 19 + length({escaped.format("role")}) END AS chars FROM t),
q AS (SELECT *, pos = 1 AND role = 'system' AS head FROM p),
c AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
             coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
             coalesce(sum(size) FILTER (head), 0)::BIGINT AS used, coalesce(sum(chars) FILTER (head), 0)::BIGINT + 3 AS fixed,
             coalesce(list(size ORDER BY pos) FILTER (NOT head), []) AS sizes, coalesce(list(chars ORDER BY pos) FILTER (NOT head), []) AS wide FROM q GROUP BY conv_id),
s AS (SELECT conv_id, fixed, sizes, len(sizes) AS n, CASE WHEN used > 0 THEN greatest({budget} - used, {budget // chat.LEAST_ROOM}) ELSE {budget} END AS room,
             list_transform(range(len(sizes) + 1), lambda i: list_sum([0] || sizes[:i])::BIGINT) AS ends, list_transform(range(len(sizes) + 1), lambda i: list_sum([0] || wide[:i])::BIGINT) AS chars FROM c),
w(conv_id, lead, last) AS (
  SELECT conv_id, 0::BIGINT, CASE WHEN n = 0 THEN 0 ELSE greatest(1, len(list_filter(ends[2:], lambda x: x <= room))) END::BIGINT FROM s
  UNION ALL
  SELECT conv_id, lead, greatest(last + 1, len(list_filter(ends[2:], lambda x: x <= ends[lead + 1] + room)))::BIGINT
  FROM (SELECT w.conv_id, w.last, s.ends, s.room,
               CASE WHEN s.sizes[w.last + 1] > s.room THEN w.last
                    ELSE len(list_filter(s.ends, lambda x: x < s.ends[w.last + 1] - least({history}, s.room - s.sizes[w.last + 1]))) END::BIGINT AS lead
        FROM w JOIN s USING (conv_id) WHERE w.last < s.n) x),
f AS (SELECT conv_id, sum(fixed + chars[last + 1] - chars[lead + 1])::BIGINT AS formatted_chars, count(*) AS n_windows FROM w JOIN s USING (conv_id) GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows FROM c JOIN f USING (conv_id)"""


OP12 = op12_sql()
