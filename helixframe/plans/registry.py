"""Every operator as a query over whole tables, with its SQL where SQL can say it.

Texts are the documents; files are documents with a header line in front; sequences are their
nucleotides; the reference text is built from the nucleotides of `benchmark`; paths
come from the urls of `pages`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import bits, codecs, text
from helixframe.operators import blocks, catalog, edit, factorize, lines, range_read, reference, restore, search
from helixframe.session import spread, table, workspace
from helixframe.sources import config, files, mutations

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BLOCK, STEP, K = 1000, 1000, 16
#: Sizes of the range reference (text up to, chunk), and how far from its place a block's factors begin.
RANGES, REACH = ((1000, 250), (4000, 500), (1 << 40, 1000)), 3000
#: Factors below SHORT characters make segments; matches of LEAST or more that end in VALID count as valid.
SHORT, LEAST, VALID = 5, 6, [(1024, 1600), (1700, 1 << 40)]
#: Symbols of a prepared reference, and of its segments.
PREPARED, SEGMENT = 20_000, 500

#: Views that the SQL of several queries starts from.
_UP = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_SEQ = f"seq AS (SELECT doc_id AS file_id, regexp_replace({_UP.format('text')}, '[^ACGT]', '', 'g') AS seq FROM documents)"
_FASTA = "fasta AS (SELECT doc_id AS file_id, '>doc' || doc_id || ' ' || lang || ' ' || source || chr(10) || text || chr(10) AS text FROM documents)"
_PATHS = "paths AS (SELECT page_id AS id, '/' || regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)"
_NL = "nl AS (SELECT file_id, k AS nl_rank, sum(n + 1) OVER (PARTITION BY file_id ORDER BY k) - 1 AS nl_pos FROM (SELECT file_id, generate_subscripts(p, 1) - 1 AS k, length(unnest(p)) AS n, len(p) AS m FROM (SELECT doc_id AS file_id, string_split(text, chr(10)) AS p FROM documents)) WHERE k < m - 1)"
_LINES = "lines AS (SELECT file_id, k AS line_no, line, regexp_matches(line, '^[>;#]') AS is_header, coalesce(sum(length(line) + 1) OVER (PARTITION BY file_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_text FROM (SELECT file_id, generate_subscripts(p, 1) - 1 AS k, unnest(p) AS line, len(p) AS m FROM (SELECT file_id, string_split(text, chr(10)) AS p FROM fasta)) WHERE k < m - 1)"
_HEADERS = "headers AS (SELECT file_id, line_no, pos_text, coalesce(sum(length(line)) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_storage, length(line) AS length FROM lines WHERE is_header)"
_REF = f"ref AS (SELECT repeat('N', 1024) || 'ACGT' || string_agg(regexp_replace({_UP.format('text')}, '[^ACGT]', '', 'g'), '' ORDER BY item_id) AS text FROM benchmark)"
_BLOCKS = f"blocks AS (SELECT file_id, b AS block_no, b * {BLOCK} AS block_start, substring(seq, b * {BLOCK} + 1, {BLOCK}) AS text FROM (SELECT file_id, seq, unnest(range(0, (length(seq) + {BLOCK} - 1) // {BLOCK})) AS b FROM seq))"
_TREE = "tree AS (SELECT path, parent, name, bool_or(is_dir) AS is_dir FROM (SELECT '/' || array_to_string(s[1:k], '/') AS path, '/' || array_to_string(s[1:k-1], '/') AS parent, s[k] AS name, k < len(s) AS is_dir FROM (SELECT s, unnest(range(1, len(s) + 1)) AS k FROM (SELECT list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM paths))) GROUP BY ALL)"
_RANGE_REF = f"{_REF.replace('ref AS', 'base AS', 1)}, body AS (SELECT substring(text, 1029, length(text)) AS s FROM base), cut AS (SELECT s, CASE WHEN length(s) <= 1000 THEN 1 WHEN length(s) <= 4000 THEN 2 ELSE 3 END AS range_class, CASE WHEN length(s) <= 1000 THEN 250 WHEN length(s) <= 4000 THEN 500 ELSE 1000 END AS c FROM body), ref AS (SELECT range_class, string_agg(repeat('N', 1024) || 'ACGT' || substring(s, b * c + 1, c), '' ORDER BY b) AS text FROM (SELECT *, unnest(range(0, (length(s) + c - 1) // c)) AS b FROM cut) GROUP BY range_class)"


def _bits(x: str) -> str:
    return f"greatest(1, length(ltrim(bin({x}), '0')))"


def _words(x: str) -> str:
    return f"4 * (({x} + 31) // 32)"


def _varbyte(x: str) -> str:
    return f"greatest(1, (length(ltrim(bin({x}), '0')) + 6) // 7)"


def _drawn(x: str) -> str:
    return f"('0x' || substring(md5({x}), 1, 13))::BIGINT"


def _factor_views(ref: str, low: str, high: str) -> str:
    """factors: greedy factorisation of `blocks`, where factors begin from low to high (SQL over block_start and m, the reference's length).

    One step takes the next factor of every block: its first 32 characters are looked up among those of all suffixes,
    and what goes on beyond them is compared with the reference itself.
    """
    return f"""{_SEQ}, {_BLOCKS}, {ref},
sa AS (SELECT p AS pos, s, row_number() OVER (ORDER BY s) - 1 AS rank FROM (SELECT p, substring(text, p + 1, length(text)) AS s FROM (SELECT text, unnest(range(0, length(text))) AS p FROM ref))),
rk AS (SELECT list(rank ORDER BY pos) AS ranks FROM sa),
framed AS (SELECT file_id, block_no, text, {low} AS lo, {high} AS hi FROM (SELECT blocks.*, length(ref.text) AS m FROM blocks, ref)),
wins AS (SELECT DISTINCT lo, hi FROM framed),
heads AS (SELECT lo, hi, g, min(rank) AS rank FROM (SELECT lo, hi, rank, unnest(list_transform(range(1, least(32, length(s)) + 1), lambda n: substring(s, 1, n))) AS g FROM sa, wins WHERE pos BETWEEN lo AND hi AND NOT starts_with(s, 'N')) WHERE NOT contains(g, 'N') GROUP BY ALL),
f AS (
  SELECT file_id, block_no, lo, hi, text, -1::BIGINT AS k, 0::BIGINT AS off, 0::BIGINT AS n, 0::BIGINT AS rank FROM framed
  UNION ALL
  SELECT file_id, block_no, lo, hi, text, k, off, n,
         CASE WHEN n > 32 THEN list_min(list_transform(list_filter(range(lo + 1, least(hi, length(r)) + 2), lambda p: substring(r, p, n) = substring(text, off + 1, n)), lambda p: ranks[p])) ELSE rank END
  FROM (
    SELECT file_id, block_no, lo, hi, text, k, off, rank, r, ranks,
           CASE WHEN n < 32 THEN n ELSE 32 + len(list_filter(range(33, length(text) - off + 1), lambda j: strpos(substring(r, lo + 1, hi - lo + j), substring(text, off + 1, j)) > 0)) END AS n
    FROM (
      SELECT q.file_id, q.block_no, q.lo, q.hi, q.text, q.k + 1 AS k, q.off, max(length(heads.g)) AS n, arg_max(heads.rank, length(heads.g)) AS rank
      FROM (SELECT file_id, block_no, lo, hi, text, k, off + n AS off, unnest(list_transform(range(1, least(32, length(text) - off - n) + 1), lambda j: substring(text, off + n + 1, j))) AS g FROM f WHERE off + n < length(text)) q
      JOIN heads ON heads.g = q.g AND heads.lo = q.lo AND heads.hi = q.hi
      GROUP BY q.file_id, q.block_no, q.lo, q.hi, q.text, q.k, q.off), (SELECT text AS r FROM ref), rk)),
factors AS (SELECT f.file_id, f.block_no, f.k AS factor_no, sa.pos AS ref_pos, f.n AS len, f.off AS text_off FROM f JOIN sa ON sa.rank = f.rank WHERE f.n > 0)"""


_FACTORS = _factor_views(_REF, "0", "m")
_NEAR_FACTORS = _factor_views(_RANGE_REF, f"greatest(0, least(block_start, m) - {REACH})", f"block_start + {REACH}")
_SIZES = f"sizes AS (SELECT file_id, block_no, {_words(f'8 + count(*) * {_bits('max(ref_pos)')}')} AS pos_bytes, {_words('sum((len >> 6) + 7)')} AS len_bytes FROM factors GROUP BY ALL)"


#: Columns whose type in SQL differs from Spark's, by query.
_TYPES: dict[str, dict[str, str]] = {
    "newline_positions": {"nl_rank": "INTEGER", "nl_pos": "BIGINT"},
    "delta_codec": {"idx": "INTEGER", "delta": "BIGINT", "restored": "BIGINT"},
    "newline_mode": {"delta": "BIGINT"},
    "newline_exceptions": {"idx": "INTEGER", "delta": "BIGINT"},
    "newline_skip": {"nl_rank": "INTEGER", "nl_pos": "BIGINT"},
    "case_runs": {"start": "BIGINT", '"end"': "BIGINT"},
    "fasta_headers": {"line_no": "INTEGER", "pos_text": "BIGINT", "pos_storage": "BIGINT"},
    "meta_rank": {"rank": "BIGINT"},
    "block_split": {"block_no": "INTEGER", "n": "INTEGER"},
    "block_offsets": {"block_no": "INTEGER", "bytes_pos": "BIGINT"},
    "factor_decode": {"block_no": "INTEGER"},
    "bitpack": {"block_no": "INTEGER"},
    "range_read": {"len": "BIGINT"},
    "search_apart": {"pos": "BIGINT"},
    "rlz_factorize": {"block_no": "INTEGER"},
    "rlz_factorize_range": {"block_no": "INTEGER"},
    "block_bitwidth": {"block_no": "INTEGER", "width": "INTEGER", "delta_width": "INTEGER"},
    "block_encoded_bytes": {"block_no": "INTEGER", "pos_bytes": "BIGINT", "len_bytes": "BIGINT", "bytes_len": "BIGINT"},
    "encoded_size": {"bytes": "BIGINT"},
    "encoded_offsets": {"block_no": "INTEGER", "bytes_pos": "BIGINT", "bytes_len": "BIGINT"},
    "segment_index": {"block_no": "INTEGER", "seg_start": "BIGINT"},
    "search_segments": {"block_no": "INTEGER", "pos": "BIGINT"},
    "codec_roundtrip": {"n": "BIGINT", "bytes": "BIGINT"},
    "segment_sample": {"draw": "INTEGER", "pos": "BIGINT"},
    "side_table_bytes": {"case_bytes": "BIGINT", "newline_bytes": "BIGINT"},
    "patch_encoded": {"block_no": "INTEGER"},
    "newline_update": {"nl_pos": "BIGINT"},
    "path_tokens": {"depth": "INTEGER"},
    "dir_summary": {"n_bytes": "BIGINT"},
    "partition_sizing": {"threads": "INTEGER"},
}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in _TYPES.get(name, {}).items())
            ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "text")


def wide_docs(spark: SparkSession, d: str) -> DataFrame:
    """The same for operators that look at every character."""
    return spread(docs(spark, d), "file_id")


def seqs(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("file_id", text.keep_acgt(F.col("text")).alias("seq"))


def fasta(spark: SparkSession, d: str) -> DataFrame:
    return spread(files.as_fasta(table(spark, d, "documents")), "file_id")


def paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("/"), F.regexp_replace("url", "^[a-z]+://", "")).alias("path"))


def ref_table(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "benchmark").select(F.lit("ref").alias("ref_id"), F.col("item_id").alias("part_no"), text.keep_acgt(F.col("text")).alias("seq"))
    return reference.build_reference(parts, "ACGT")


def ref_text(spark: SparkSession, d: str) -> str:
    return reference.collect_reference(ref_table(spark, d))


def seq_blocks(spark: SparkSession, d: str) -> DataFrame:
    return blocks.block_split(seqs(spark, d).withColumnRenamed("seq", "text"), BLOCK)


def encoded(spark: SparkSession, d: str) -> DataFrame:
    return factorize.factorize(seq_blocks(spark, d), ref_text(spark, d))


def any_ref(spark: SparkSession, d: str, stored: DataFrame) -> str:
    """A reference for texts of any kind: every symbol that occurs or may occur, then the lines of `benchmark`."""
    symbols = {r["ch"] for r in reference.alphabet_of(stored.select(F.col("seq").alias("text"))).collect()}
    body = lines.sequence_text(table(spark, d, "benchmark").select(F.col("item_id").alias("file_id"), "text"))
    parts = body.select(F.lit("ref").alias("ref_id"), F.col("file_id").alias("part_no"), "seq")
    return reference.collect_reference(reference.build_reference(parts, "".join(sorted(symbols | set(text.alphabet("full"))))))


# -- filters ---------------------------------------------------------------------------


def _filtered(name: str, f, sql: str) -> None:
    @query(name, f"SELECT doc_id AS file_id, {sql} AS seq FROM documents")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return docs(spark, d).select("file_id", f(F.col("text")).alias("seq"))


_up = _UP.format("text")
_filtered("ascii_upper", text.ascii_upper, _up)
_filtered("filter_full", text.keep_full, "replace(text, chr(0), '')")
_filtered("filter_nonl", text.keep_one_line, "replace(replace(text, chr(0), ''), chr(10), '')")
_filtered("filter_basic", text.keep_acgnt, f"regexp_replace({_up}, '[^ACGNT]', '', 'g')")
_filtered("ref_filter_acgt", text.keep_acgt, f"regexp_replace({_up}, '[^ACGT]', '', 'g')")
_filtered("ref_filter_alnum", text.keep_alnum, f"regexp_replace({_up}, '[^A-Z0-9]', '', 'g')")


@query("seq_scan", f"SELECT doc_id AS file_id, {_up} AS seq, length(text) AS n, len(regexp_extract_all(text, '[a-z]+')) AS n_runs FROM documents")
def seq_scan(spark, d):
    t = text.keep_full(F.col("text"))
    return docs(spark, d).select("file_id", text.ascii_upper(t).alias("seq"), F.char_length(t).cast("long").alias("n"), F.regexp_count(t, F.lit("[a-z]+")).cast("long").alias("n_runs"))


@query("alphabet", "SELECT 'full' AS name, i - 1 AS pos, chr(i::INTEGER) AS ch FROM range(1, 256) t(i) UNION ALL SELECT 'nonl', row_number() OVER (ORDER BY i) - 1, chr(i::INTEGER) FROM range(1, 256) t(i) WHERE i <> 10 UNION ALL SELECT 'basic', instr('ACGNT', c) - 1, c FROM (SELECT unnest(string_split('ACGNT', '')) AS c)")
def alphabets(spark, d):
    rows = [(n, k, c) for n in ("full", "nonl", "basic") for k, c in enumerate(text.alphabet(n))]
    return spark.createDataFrame(rows, "name string, pos long, ch string")


@query("nibble_code", f"WITH {_SEQ}, h AS (SELECT file_id, regexp_replace(translate(seq, 'ACGTN', '12345'), '[^1-5]', '0', 'g') AS x FROM seq) SELECT file_id, regexp_replace(CASE WHEN length(x) % 2 = 1 THEN x || '0' ELSE x END, '(.)(.)', '\\2\\1', 'g') AS code FROM h")
def nibble(spark, d):
    return seqs(spark, d).select("file_id", text.nibble_code(F.col("seq")).alias("code"))


@query("nibble_decode", f"WITH {_SEQ} SELECT file_id, seq FROM seq")
def nibble_decode(spark, d):
    coded = seqs(spark, d).select("file_id", text.nibble_code(F.col("seq")).alias("code"), F.char_length("seq").alias("n"))
    return coded.select("file_id", text.nibble_decode(F.col("code"), F.col("n")).alias("seq"))


@query("kr_hash", f"WITH {_SEQ} SELECT file_id, list_reduce(list_prepend(0::BIGINT, list_transform(list_filter(string_split(seq, ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 256 + c) % 15485863) AS hash FROM seq")
def kr_hash(spark, d):
    return seqs(spark, d).select("file_id", text.rolling_hash(F.col("seq")).alias("hash"))


# -- line feeds, case, headers -----------------------------------------------------------


@query("newline_positions", f"WITH {_NL} SELECT file_id, nl_rank, nl_pos FROM nl")
def newline_positions(spark, d):
    return lines.newline_positions(wide_docs(spark, d))


_DELTAS = f"{_NL}, deltas AS (SELECT file_id, nl_rank AS idx, nl_pos - coalesce(lag(nl_pos) OVER (PARTITION BY file_id ORDER BY nl_pos), 0) AS delta, nl_pos AS restored FROM nl), counts AS (SELECT file_id, delta, count(*) AS cnt FROM deltas GROUP BY ALL), modes AS (SELECT file_id, delta, cnt FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY cnt DESC, delta) AS k FROM counts) WHERE k = 1)"


@query("delta_codec", f"WITH {_DELTAS} SELECT file_id, idx, delta, restored FROM deltas")
def delta_codec(spark, d):
    return lines.newline_deltas(lines.newline_positions(wide_docs(spark, d)))


@query("newline_mode", f"WITH {_DELTAS} SELECT file_id, delta, cnt FROM modes")
def newline_mode(spark, d):
    return lines.newline_mode(lines.newline_deltas(lines.newline_positions(wide_docs(spark, d))))


@query("newline_exceptions", f"WITH {_DELTAS} SELECT d.file_id, d.idx, d.delta FROM deltas d JOIN modes m ON d.file_id = m.file_id WHERE d.delta <> m.delta")
def newline_exceptions(spark, d):
    return lines.newline_exceptions(lines.newline_deltas(lines.newline_positions(wide_docs(spark, d))))


@query("newline_skip", f"WITH {_NL} SELECT file_id, nl_rank, nl_pos FROM nl WHERE nl_rank % 1024 = 0")
def newline_skip(spark, d):
    return lines.newline_skips(lines.newline_positions(wide_docs(spark, d)))


@query("newline_rank", f"SELECT file_id, probe, length(p) - length(replace(p, chr(10), '')) AS rank FROM (SELECT doc_id AS file_id, b * {STEP} AS probe, substring(text, 1, b * {STEP}) AS p FROM (SELECT doc_id, text, unnest(range(0, length(text) // {STEP} + 1)) AS b FROM documents))")
def newline_rank(spark, d):
    return lines.newline_ranks(wide_docs(spark, d), STEP)


@query("case_runs", """WITH pieces AS (SELECT file_id, k, s, sum(length(s)) OVER (PARTITION BY file_id ORDER BY k) AS upto FROM (SELECT doc_id AS file_id, generate_subscripts(p, 1) AS k, unnest(p) AS s FROM (SELECT doc_id, regexp_extract_all(text, '[a-z]+|[^a-z]+') AS p FROM documents))) SELECT file_id, upto - length(s) AS start, upto - 1 AS "end" FROM pieces WHERE regexp_matches(s, '^[a-z]')""")
def case_runs(spark, d):
    return lines.case_runs(wide_docs(spark, d))


@query("fasta_headers", f"WITH {_FASTA}, {_LINES}, {_HEADERS} SELECT * FROM headers")
def fasta_headers(spark, d):
    return lines.header_table(fasta(spark, d)).drop("line")


@query("meta_rank", f"WITH {_FASTA}, {_LINES}, {_HEADERS}, probes AS (SELECT file_id, unnest(range(0, length(text) // {STEP} + 1)) * {STEP} AS probe FROM fasta) SELECT p.file_id, p.probe, coalesce(sum(least(h.length + 1, p.probe - h.pos_text)), 0) AS rank FROM probes p LEFT JOIN headers h ON h.file_id = p.file_id AND h.pos_text < p.probe GROUP BY p.file_id, p.probe")
def meta_rank(spark, d):
    return lines.header_ranks(fasta(spark, d), STEP)


@query("fasta_sequence", f"SELECT doc_id AS file_id, replace({_up}, chr(10), '') AS seq FROM documents")
def fasta_sequence(spark, d):
    return lines.sequence_text(fasta(spark, d))


@query("restore_newlines", f"SELECT doc_id AS file_id, {_UP.format('text')} || chr(10) AS text FROM documents")
def restore_newlines(spark, d):
    return restore.restore_newlines(lines.strip(fasta(spark, d)))


@query("restore_headers", f"WITH {_FASTA} SELECT file_id, {_UP.format('text')} AS text FROM fasta")
def restore_headers(spark, d):
    stored = lines.strip(fasta(spark, d))
    return restore.restore_headers(restore.restore_newlines(stored), stored)


@query("restore_case", f"WITH {_FASTA} SELECT file_id, text FROM fasta")
def restore_case(spark, d):
    stored = lines.strip(fasta(spark, d))
    upper = fasta(spark, d).select("file_id", text.ascii_upper(F.col("text")).alias("text"))
    return restore.restore_case(upper, stored)


@query("restore_files", f"WITH {_FASTA} SELECT file_id, text FROM fasta")
def restore_files(spark, d):
    """All three steps at once."""
    return restore.restore(lines.strip(fasta(spark, d)))


@query("side_table_bytes", f"""WITH {_DELTAS}, {{runs}}, gaps AS (SELECT file_id, s - coalesce(lag(e) OVER (PARTITION BY file_id ORDER BY s), 0) AS gap, e - s AS n FROM runs),
c AS (SELECT file_id, sum({_varbyte('gap')} + {_varbyte('n')}) AS c FROM gaps GROUP BY file_id),
odd AS (SELECT d.file_id, d.delta, d.idx - coalesce(lag(d.idx) OVER (PARTITION BY d.file_id ORDER BY d.idx), 0) AS step FROM deltas d JOIN modes m ON d.file_id = m.file_id WHERE d.delta <> m.delta),
l AS (SELECT file_id, sum({_varbyte('step::BIGINT')} + {_varbyte('delta::BIGINT')}) AS l FROM odd GROUP BY file_id)
SELECT doc_id AS file_id, 8 + coalesce(c, 0) AS case_bytes, 16 + coalesce(l, 0) AS newline_bytes FROM documents LEFT JOIN c ON c.file_id = doc_id LEFT JOIN l ON l.file_id = doc_id""".replace("{runs}", "runs AS (SELECT file_id, (upto - length(x))::BIGINT AS s, (upto - 1)::BIGINT AS e FROM (SELECT file_id, x, sum(length(x)) OVER (PARTITION BY file_id ORDER BY k) AS upto FROM (SELECT doc_id AS file_id, generate_subscripts(p, 1) AS k, unnest(p) AS x FROM (SELECT doc_id, regexp_extract_all(text, '[a-z]+|[^a-z]+') AS p FROM documents))) WHERE regexp_matches(x, '^[a-z]'))"))
def side_table_bytes(spark, d):
    return lines.side_table_bytes(wide_docs(spark, d))


# -- codes ---------------------------------------------------------------------------------


def _bit_sizes(name: str, f, sql: str) -> None:
    @query(name, f"SELECT o_orderkey AS id, {sql} AS v FROM (SELECT o_orderkey, o_orderkey AS n, length(CASE WHEN o_orderkey = 0 THEN '0' ELSE ltrim(bin(o_orderkey), '0') END) AS b FROM orders)")
    def run(spark, d):
        return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), f(F.col("o_orderkey")).cast("long").alias("v"))


_bit_sizes("n_bits", bits.n_bits, "b")
_bit_sizes("golomb_bits", bits.golomb_bits, "(n >> 6) + 7")
_bit_sizes("gamma_bits", lambda n: bits.gamma_bits(n + 1), "2 * (length(ltrim(bin(n + 1), '0')) - 1) + 1")
_bit_sizes("varbyte_size", bits.varbyte_size, "greatest(1, (b + 6) // 7)")


_KEYS = "keys AS (SELECT o_custkey, o_orderkey AS v, min(o_orderkey) OVER (PARTITION BY o_custkey) AS low FROM orders)"


@query("codec_roundtrip", f"""WITH {_KEYS}, sizes AS (SELECT count(*) AS n, {_words(f"8 + count(*) * {_bits('max(v)')}")} AS maxbits, {_words(f"40 + count(*) * {_bits('max(v - low)')}")} AS delta, {_words('sum((v >> 6) + 7)')} AS golomb, {_words(f"sum(2 * {_bits('v + 1')} - 1)")} AS gamma, sum({_varbyte('v')}) AS varbyte FROM keys GROUP BY o_custkey)
SELECT codec, sum(n) AS n, sum(bytes) AS bytes, true AS ok FROM (UNPIVOT (SELECT n, maxbits::BIGINT AS maxbits, delta::BIGINT AS delta, golomb::BIGINT AS golomb, gamma::BIGINT AS gamma, varbyte::BIGINT AS varbyte FROM sizes) ON maxbits, delta, golomb, gamma, varbyte INTO NAME codec VALUE bytes) GROUP BY codec""")
def codec_roundtrip(spark, d):
    """codec, n, bytes, ok: every integer code over the order keys of each customer."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for values in batch["v"].to_pylist():
                x = np.array(values, np.int64)
                for name, (pack, unpack) in codecs.CODECS.items():
                    data = pack(x)
                    out.append((name, len(x), len(data), bool((unpack(data, len(x)) == x).all())))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.bool_()))], names=["codec", "n", "bytes", "ok"])

    keys = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("v"))
    rows = keys.select("v").mapInArrow(run, "codec string, n long, bytes long, ok boolean")
    return rows.groupBy("codec").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.bool_and("ok").alias("ok"))


# -- blocks and references ---------------------------------------------------------------------


@query("block_split", f"WITH {_SEQ}, {_BLOCKS} SELECT file_id, block_no, block_start, length(text) AS n, text FROM blocks")
def block_split(spark, d):
    return seq_blocks(spark, d)


_BYTES = f"b AS (SELECT file_id, block_no, strlen(text) AS bytes_len FROM (SELECT doc_id AS file_id, unnest(range(0, (length(text) + {BLOCK} - 1) // {BLOCK})) AS block_no, text AS whole FROM documents), LATERAL (SELECT substring(whole, block_no * {BLOCK} + 1, {BLOCK}) AS text))"


@query("block_offsets", f"WITH {_BYTES} SELECT file_id, block_no, coalesce(sum(bytes_len) OVER (PARTITION BY file_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bytes_pos, bytes_len FROM b")
def block_offsets(spark, d):
    return blocks.block_offsets(blocks.block_split(docs(spark, d), BLOCK).select("file_id", "block_no", F.octet_length("text").cast("long").alias("bytes_len")))


@query("ref_build", f"WITH {_REF} SELECT 'ref' AS ref_id, text FROM ref")
def ref_build(spark, d):
    return ref_table(spark, d)


@query("ref_build_ranges", f"WITH {_REF}, body AS (SELECT substring(text, 1029, length(text)) AS s FROM ref), cut AS (SELECT s, CASE WHEN length(s) <= 1000 THEN 1 WHEN length(s) <= 4000 THEN 2 ELSE 3 END AS range_class, CASE WHEN length(s) <= 1000 THEN 250 WHEN length(s) <= 4000 THEN 500 ELSE 1000 END AS c FROM body) SELECT 'ref' AS ref_id, range_class, string_agg(repeat('N', 1024) || 'ACGT' || substring(s, b * c + 1, c), '' ORDER BY b) AS text FROM (SELECT *, unnest(range(0, (length(s) + c - 1) // c)) AS b FROM cut) GROUP BY range_class")
def ref_build_ranges(spark, d):
    parts = table(spark, d, "benchmark").select(F.lit("ref").alias("ref_id"), F.col("item_id").alias("part_no"), text.keep_acgt(F.col("text")).alias("seq"))
    return reference.build_range_reference(parts, "ACGT", RANGES)


_SA = f"{_REF}, sa AS (SELECT row_number() OVER (ORDER BY s) - 1 AS rank, p AS pos FROM (SELECT p, substring(text, p + 1, length(text)) AS s FROM (SELECT text, unnest(range(0, length(text))) AS p FROM ref)))"


@query("suffix_array", f"WITH {_SA} SELECT 'ref' AS ref_id, rank, pos FROM sa")
def suffix_array(spark, d):
    return reference.suffix_order(ref_table(spark, d))


@query("sa_sample", f"WITH {_SA} SELECT 'ref' AS ref_id, rank, pos FROM sa WHERE pos < 1280 OR pos % 10 = 0")
def sa_sample(spark, d):
    return reference.sample_order(reference.suffix_order(ref_table(spark, d)), 10)


@query("suffix_array_tables", f"WITH {_SA} SELECT rank, pos FROM sa")
def suffix_array_tables(spark, d):
    """The same for texts beyond one task: sorts and joins of tables."""
    symbols = ref_table(spark, d).select(F.posexplode(text.chars(F.col("text"))).alias("pos", "ch"))
    return reference.suffix_order_distributed(symbols.select(F.col("pos").cast("long").alias("pos"), "ch"))


@query("reference_store", f"WITH {_SA} SELECT 'ref' AS ref_id, rank, pos FROM sa WHERE pos < 1280 OR pos % 10 = 0")
def reference_store(spark, d):
    """A reference with both kinds of its suffix order, written as tables; the sampled one read again."""
    path = workspace(spark, "reference")
    files.save_reference(ref_table(spark, d), path, 10)
    return files.load_reference(spark, path, files.SAMPLED)[1]


@query("distinct_alphabet", "SELECT DISTINCT ch FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> ''")
def distinct_alphabet(spark, d):
    return reference.alphabet_of(wide_docs(spark, d))


@query("trigram_counts", f"WITH {_SEQ}, p AS (SELECT seq || list_min(string_split(seq, '')) || list_min(string_split(seq, '')) AS s, length(seq) AS n FROM seq WHERE seq <> '') SELECT substring(s, i, 3) AS gram, count(*) AS n FROM (SELECT s, unnest(range(1, n + 1)) AS i FROM p) GROUP BY gram")
def trigram_counts(spark, d):
    return reference.gram_counts(spread(seqs(spark, d), "file_id").select(F.col("seq").alias("text")))


_KMERS = f"{_SEQ}, kmers AS (SELECT kmer, count(*) AS cnt, min(file_id * 1000000000 + i - 1) AS first_at FROM (SELECT file_id, i, substring(seq, i, {K}) AS kmer FROM (SELECT file_id, seq, unnest(range(1, length(seq) - {K} + 2)) AS i FROM seq)) GROUP BY kmer)"


@query("kmer_frequency", f"WITH {_KMERS} SELECT * FROM kmers")
def kmer_frequency(spark, d):
    return reference.kmer_frequency(spread(seqs(spark, d), "file_id"), K)


@query("kmer_topk", f"WITH {_KMERS} SELECT * FROM kmers WHERE cnt > 1 ORDER BY cnt DESC, first_at DESC, kmer LIMIT 20")
def kmer_topk(spark, d):
    return reference.top_kmers(reference.kmer_frequency(spread(seqs(spark, d), "file_id"), K))


@query("segment_sample", f"WITH {_SEQ} SELECT file_id, draw, {_drawn("'0:' || file_id || ':' || draw")} % greatest(1, length(seq) - 99) AS pos, substring(seq, ({_drawn("'0:' || file_id || ':' || draw")} % greatest(1, length(seq) - 99))::INT + 1, 100) AS text FROM (SELECT *, unnest([0, 1, 2]) AS draw FROM seq WHERE seq <> '')")
def segment_sample(spark, d):
    return reference.sample_segments(seqs(spark, d), 100, 3)


@query("ref_prepare", f"""WITH {_KMERS}, t AS (SELECT sum(length(seq))::BIGINT AS total FROM seq), n AS (SELECT file_id, seq, (length(seq) * {PREPARED * 9 // 10 // SEGMENT}) // total + ({_drawn("'share:' || file_id")} % total < (length(seq) * {PREPARED * 9 // 10 // SEGMENT}) % total)::INT AS n FROM seq, t),
draws AS (SELECT file_id, seq, unnest(range(0, n)) AS draw FROM n WHERE n > 0 AND seq <> '')
SELECT * FROM (SELECT 'kmer' AS source, cnt AS weight, kmer AS text FROM kmers WHERE cnt > 1 ORDER BY cnt DESC, first_at DESC, kmer LIMIT {PREPARED // 10 // K})
UNION ALL SELECT 'segment', file_id, substring(seq, ({_drawn("'0:' || file_id || ':' || draw")} % greatest(1, length(seq) - {SEGMENT - 1}))::INT + 1, {SEGMENT}) FROM draws""")
def ref_prepare(spark, d):
    """A small reference: the same shares as with the defaults (128 and 5000 symbols), pieces scaled to these tables."""
    return reference.prepare_reference(seqs(spark, d), PREPARED, K, SEGMENT)


# -- factors --------------------------------------------------------------------------------------


@query("rlz_factorize", f"WITH RECURSIVE {_FACTORS} SELECT * FROM factors")
def rlz_factorize(spark, d):
    return factorize.factors(encoded(spark, d))


@query("rlz_factorize_range", f"WITH RECURSIVE {_NEAR_FACTORS} SELECT * FROM factors")
def rlz_factorize_range(spark, d):
    """Factors near their block's own place in a reference that repeats its alphabet."""
    near = reference.collect_reference(ref_build_ranges(spark, d))
    return factorize.factors(factorize.factorize_near(seq_blocks(spark, d), near, REACH))


@query("rlz_min_length")
def rlz_min_length(spark, d):
    """Matches of some length that end in the valid parts of the reference; other characters alone at -1."""
    return factorize.factors(factorize.factorize_valid(seq_blocks(spark, d), ref_text(spark, d), LEAST, VALID))


@query("factor_decode", f"WITH {_SEQ}, {_BLOCKS} SELECT file_id, block_no, text FROM blocks")
def factor_decode(spark, d):
    return factorize.decode(encoded(spark, d), ref_text(spark, d))


@query("decode_full", f"WITH {_SEQ} SELECT file_id, seq AS text FROM seq WHERE seq <> ''")
def decode_full(spark, d):
    return factorize.join_blocks(factorize.decode(encoded(spark, d), ref_text(spark, d)))


@query("bitpack", f"WITH {_SEQ}, {_BLOCKS} SELECT file_id, block_no, text FROM blocks")
def bitpack(spark, d):
    """Factors to bytes, bytes to factors, factors to texts."""
    return factorize.decode(factorize.decode_blocks(factorize.encode_blocks(encoded(spark, d))), ref_text(spark, d))


@query("block_bitwidth", f"WITH RECURSIVE {_FACTORS} SELECT file_id, block_no, count(*) AS n, min(ref_pos) AS low, max(ref_pos) AS high, {_bits('max(ref_pos)')} AS width, {_bits('max(ref_pos) - min(ref_pos)')} AS delta_width FROM factors GROUP BY file_id, block_no")
def block_bitwidth(spark, d):
    return factorize.block_widths(encoded(spark, d))


@query("block_encoded_bytes", f"WITH RECURSIVE {_FACTORS}, {_SIZES} SELECT *, pos_bytes + len_bytes AS bytes_len FROM sizes")
def block_encoded_bytes(spark, d):
    return factorize.encoded_bytes(encoded(spark, d))


@query("encoded_size", f"WITH RECURSIVE {_FACTORS}, {_SIZES} SELECT file_id, count(*) AS n_blocks, sum(pos_bytes + len_bytes) AS bytes FROM sizes GROUP BY file_id")
def encoded_size(spark, d):
    return factorize.encoded_bytes(encoded(spark, d)).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum("bytes_len").alias("bytes"))


@query("encoded_offsets", f"WITH RECURSIVE {_FACTORS}, {_SIZES} SELECT file_id, block_no, coalesce(sum(pos_bytes + len_bytes) OVER (PARTITION BY file_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bytes_pos, pos_bytes + len_bytes AS bytes_len FROM sizes")
def encoded_offsets(spark, d):
    return blocks.block_offsets(factorize.encoded_bytes(encoded(spark, d)))


@query("segment_index", f"WITH RECURSIVE {_FACTORS}, runs AS (SELECT file_id, block_no, min(text_off) AS seg_start, sum(len) AS n FROM (SELECT *, factor_no - row_number() OVER (PARTITION BY file_id, block_no ORDER BY factor_no) AS run FROM factors WHERE len < {SHORT}) GROUP BY file_id, block_no, run) SELECT r.file_id, r.block_no, r.seg_start, substring(b.text, r.seg_start + 1, r.n::BIGINT) AS seg_text FROM runs r JOIN blocks b ON b.file_id = r.file_id AND b.block_no = r.block_no")
def segment_index(spark, d):
    return factorize.short_factor_segments(encoded(spark, d), ref_text(spark, d), SHORT)


@query("search_segments", f"WITH RECURSIVE {_FACTORS}, placed AS (SELECT *, block_no * {BLOCK} + text_off AS place, row_number() OVER (PARTITION BY file_id ORDER BY block_no, factor_no) AS k FROM factors), runs AS (SELECT file_id, min(place) AS start, sum(len) AS n FROM (SELECT *, k - row_number() OVER (PARTITION BY file_id ORDER BY k) AS run FROM placed WHERE len < {SHORT}) GROUP BY file_id, run), texts AS (SELECT r.file_id, r.start, substring(s.seq, r.start + 1, r.n::BIGINT) AS t FROM runs r JOIN seq s ON s.file_id = r.file_id), hits AS (SELECT file_id, start + unnest(list_filter(range(0, length(t)), lambda i: substring(t, i + 1, 4) = 'TACG')) AS place FROM texts) SELECT file_id, place // {BLOCK} AS block_no, place % {BLOCK} AS pos FROM hits")
def search_segments(spark, d):
    return search.search_segments(factorize.short_factor_segments(encoded(spark, d), ref_text(spark, d), SHORT), "TACG", BLOCK)


@query("text_size", f"WITH {_FASTA} SELECT file_id, length(text) AS n FROM fasta")
def text_size(spark, d):
    """Sequence, line feeds and headers of the stored parts add up to the text."""
    stored = lines.strip(fasta(spark, d))
    feeds = F.size("line_sizes") - 1
    return stored.select("file_id", (F.char_length("seq") + F.char_length("headers") + feeds).cast("long").alias("n"))


def _probes(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 120 characters at every 2500th place of every file, past its end too."""
    rows = fasta(spark, d).select("file_id", F.explode(F.sequence(F.lit(0), F.floor(F.char_length("text") / 2500))).alias("k"))
    return rows.select("file_id", (F.col("k") * 2500).cast("long").alias("start"), F.lit(120).cast("long").alias("len"))


@query("range_read", f"WITH {_FASTA} SELECT file_id, k * 2500 AS start, 120 AS len, substring(text, k * 2500 + 1, 120) AS out FROM (SELECT file_id, text, unnest(range(0, length(text) // 2500 + 1)) AS k FROM fasta)")
def range_read_query(spark, d):
    stored = lines.strip(fasta(spark, d))
    whole = any_ref(spark, d, stored)
    cut = blocks.block_split(stored.select("file_id", F.col("seq").alias("text")), BLOCK)
    return range_read.range_read(_probes(spark, d), stored.drop("seq"), factorize.factorize(cut, whole), whole, BLOCK)


@query("meta_blocks")
def meta_blocks(spark, d):
    """file_id, n, packed, ok: header stores as compressed bytes with a check sum, read back."""
    import lzma
    import zlib

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            raw = [h.encode() for h in batch["headers"].to_pylist()]
            packed = [lzma.compress(x, preset=6, check=lzma.CHECK_CRC32) for x in raw]
            ok = [zlib.crc32(lzma.decompress(p)) == zlib.crc32(x) for p, x in zip(packed, raw, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["file_id"], pa.array(list(map(len, raw)), pa.int64()), pa.array(list(map(len, packed)), pa.int64()), pa.array(ok)], names=["file_id", "n", "packed", "ok"])

    return lines.strip(fasta(spark, d)).select("file_id", "headers").mapInArrow(run, "file_id long, n long, packed long, ok boolean")


# -- search -----------------------------------------------------------------------------------------


@query("search_all", "SELECT doc_id AS file_id, i - 1 AS pos FROM (SELECT doc_id, text, unnest(list_filter(range(1, length(text)), lambda i: text[i:i+1] = 'en')) AS i FROM documents)")
def search_all(spark, d):
    return search.search_all(wide_docs(spark, d), "en")


@query("search_nonoverlap", "SELECT doc_id AS file_id, len(regexp_extract_all(text, 'ere')) AS cnt FROM documents")
def search_nonoverlap(spark, d):
    return search.count_apart(docs(spark, d), "ere")


@query("search_apart", "SELECT file_id, sum(n + 3) OVER (PARTITION BY file_id ORDER BY k) - 3 AS pos FROM (SELECT doc_id AS file_id, generate_subscripts(p, 1) AS k, length(unnest(p)) AS n, len(p) AS m FROM (SELECT doc_id, string_split(text, 'ere') AS p FROM documents)) WHERE k < m")
def search_apart(spark, d):
    return search.search_apart(docs(spark, d), "ere")


# -- changes -------------------------------------------------------------------------------------------


def _patches(spark: SparkSession, d: str) -> DataFrame:
    """A line with the document's number, written in the middle of each document."""
    new = F.concat(F.lit("PATCH\n"), F.col("file_id").cast("string"), F.lit("\n"))
    return docs(spark, d).select("file_id", F.floor(F.char_length("text") / 2).cast("int").alias("at"), new.alias("new"))


_PATCHED = "patched AS (SELECT doc_id AS file_id, substring(text, 1, length(text) // 2) || new || substring(text, length(text) // 2 + length(new) + 1, length(text)) AS text FROM (SELECT *, 'PATCH' || chr(10) || doc_id || chr(10) AS new FROM documents))"


@query("patch_text", f"WITH {_PATCHED} SELECT file_id, text FROM patched")
def patch_text(spark, d):
    return edit.patch_text(docs(spark, d), _patches(spark, d))


@query("patch_encoded", f"WITH {_SEQ}, spliced AS (SELECT file_id, substring(seq, 1, length(seq) // 2) || 'ACGTTGCATTTACCA' || substring(seq, length(seq) // 2 + 16, length(seq)) AS seq FROM seq), {_BLOCKS.replace('FROM seq)', 'FROM spliced)')} SELECT file_id, block_no, text FROM blocks")
def patch_encoded(spark, d):
    """A short sequence written into the middle of every encoded file; only the blocks that it touches are encoded again."""
    patches = seqs(spark, d).select("file_id", F.floor(F.char_length("seq") / 2).cast("int").alias("at"), F.lit("ACGTTGCATTTACCA").alias("new"))
    ref = ref_text(spark, d)
    return factorize.decode(edit.patch_encoded(encoded(spark, d), patches, ref, BLOCK), ref)


@query("newline_update", f"WITH {_PATCHED} SELECT file_id, sum(n + 1) OVER (PARTITION BY file_id ORDER BY k) - 1 AS nl_pos FROM (SELECT file_id, generate_subscripts(p, 1) AS k, length(unnest(p)) AS n, len(p) AS m FROM (SELECT file_id, string_split(text, chr(10)) AS p FROM patched)) WHERE k < m")
def newline_update(spark, d):
    return edit.shifted_newlines(lines.newline_positions(wide_docs(spark, d)), _patches(spark, d))


@query("touched_blocks", f"SELECT file_id, unnest(range(a // {BLOCK}, (a + n - 1) // {BLOCK} + 1)) AS block_no FROM (SELECT doc_id AS file_id, length(text) // 2 AS a, 7 + length(doc_id::VARCHAR) AS n FROM documents)")
def touched_blocks(spark, d):
    return edit.touched_blocks(_patches(spark, d), BLOCK)


@query("truncate_text", "SELECT doc_id AS file_id, substring(text, 1, 500) AS text, greatest(0, 500 - length(text)) AS n_pad FROM documents")
def truncate_text(spark, d):
    rows = edit.truncate_text(docs(spark, d), F.lit(500))
    return rows.select("file_id", text.keep_full(F.col("text")).alias("text"), (F.char_length("text") - F.char_length(text.keep_full(F.col("text")))).cast("long").alias("n_pad"))


@query("mutation_overlay", "SELECT doc_id AS file_id, array_to_string(list_transform(range(1, length(text) + 1), lambda i: CASE WHEN i % 97 = 1 THEN 'N' ELSE text[i] END), '') AS text FROM documents")
def mutation_overlay(spark, d):
    base = wide_docs(spark, d)
    places = base.select("file_id", F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.char_length("text") / 97)), lambda k: k * 97)).alias("pos")).withColumn("ch", F.lit("N"))
    sizes = base.select("file_id", F.char_length("text").alias("n"))
    return edit.overlay(base, edit.valid_mutations(places, sizes))


# -- paths and files --------------------------------------------------------------------------------------


@query("path_tokens", f"WITH {_PATHS} SELECT id, generate_subscripts(s, 1) - 1 AS depth, unnest(s) AS name FROM (SELECT id, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM paths)")
def path_tokens(spark, d):
    return catalog.path_tokens(paths(spark, d))


@query("dir_tree", f"WITH {_PATHS}, {_TREE} SELECT path, parent, name, is_dir FROM tree")
def dir_tree(spark, d):
    return catalog.dir_tree(paths(spark, d))


@query("tree_remove", f"WITH {_PATHS}, {_TREE} SELECT path, parent, name, is_dir FROM tree WHERE NOT (name = 'en' OR path LIKE '%/en/%')")
def tree_remove(spark, d):
    """Directories named `en` go, with all below them."""
    tree = catalog.dir_tree(paths(spark, d))
    return catalog.remove(tree, tree.filter((F.col("name") == "en") | F.col("path").contains("/en/")).select("path"))


@query("rename", f"WITH {_PATHS} SELECT CASE WHEN ends_with(path, '.html') THEN path || '.z' WHEN path LIKE '%/es/%' THEN replace(path, '/es/', '/moved/') ELSE path END AS path, CASE WHEN ends_with(path, '.html') THEN 'encode' ELSE 'none' END AS action FROM (SELECT DISTINCT path FROM paths)")
def rename(spark, d):
    """Files that get the suffix are encoded, other moves change the name only."""
    some = paths(spark, d).select("path").distinct()
    page = F.col("path").endswith(".html")
    moves = some.filter(page | F.col("path").contains("/es/")).select(F.col("path").alias("old"), F.when(page, F.concat("path", F.lit(".z"))).otherwise(F.replace("path", F.lit("/es/"), F.lit("/moved/"))).alias("new"))
    return catalog.rename_all(some, moves, ".z")


@query("dir_listing", f"WITH {_PATHS}, {_TREE} SELECT parent, count(*) FILTER (is_dir) AS n_dirs, count(*) FILTER (NOT is_dir) AS n_files FROM tree GROUP BY parent")
def dir_listing(spark, d):
    return catalog.dir_listing(catalog.dir_tree(paths(spark, d)))


@query("listing_serde", f"WITH {_PATHS}, {_TREE} SELECT parent, name, is_dir FROM tree")
def listing_serde(spark, d):
    return catalog.parse_listing(catalog.serialize_listing(catalog.dir_tree(paths(spark, d))))


@query("dir_summary", f"WITH {_PATHS} SELECT regexp_replace(path, '[^/]*$', '') AS dir, count(*) AS n_files, sum(length(html)) AS n_bytes FROM paths JOIN pages ON id = page_id GROUP BY 1")
def dir_summary(spark, d):
    sizes = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.char_length("html").alias("size"))
    return catalog.dir_summary(paths(spark, d).join(sizes, "id"))


@query("route_reference", f"WITH {_PATHS}, routes AS (SELECT DISTINCT '/' || string_split(path, '/')[2] || '/' || string_split(path, '/')[3] AS prefix, 'ref-' || string_split(path, '/')[3] AS ref_id FROM paths WHERE string_split(path, '/')[3] <> 'en' UNION SELECT DISTINCT '/' || string_split(path, '/')[2], 'ref-host' FROM paths WHERE NOT string_split(path, '/')[2] LIKE '%.org') SELECT p.id, p.path, max_by(r.ref_id, length(r.prefix)) AS ref_id FROM paths p LEFT JOIN routes r ON starts_with(p.path, r.prefix || '/') AND length(p.path) > length(r.prefix) + 1 GROUP BY p.id, p.path")
def route_reference(spark, d):
    steps = F.split("path", "/")
    host, lang = F.get(steps, F.lit(1)), F.get(steps, F.lit(2))
    some = paths(spark, d)
    deep = some.filter(lang != "en").select(F.concat(F.lit("/"), host, F.lit("/"), lang).alias("prefix"), F.concat(F.lit("ref-"), lang).alias("ref_id"))
    wide = some.filter(~host.endswith(".org")).select(F.concat(F.lit("/"), host).alias("prefix"), F.lit("ref-host").alias("ref_id"))
    return catalog.route(some, deep.union(wide).distinct())


@query("path_join", f"WITH {_PATHS} SELECT id, '/mnt' || path AS joined, '/mnt' || path AS joined_slash FROM paths")
def path_join(spark, d):
    return paths(spark, d).select("id", text.path_join(F.lit("/mnt"), F.substring("path", F.lit(2), F.char_length("path"))).alias("joined"), text.path_join(F.lit("/mnt/"), F.col("path")).alias("joined_slash"))


@query("path_suffix", f"WITH {_PATHS} SELECT id, ends_with(path, '.html') AND length(path) > 5 AS hit FROM paths")
def path_suffix(spark, d):
    return paths(spark, d).select("id", text.has_suffix(F.col("path"), ".html").alias("hit"))


@query("partition_sizing", "SELECT doc_id AS file_id, greatest(1, least(4, length(text) // 1600)) AS threads FROM documents")
def partition_sizing(spark, d):
    return docs(spark, d).select("file_id", text.encode_threads(F.char_length("text"), 100).alias("threads"))


@query("path_clean", f"WITH {_PATHS} SELECT id, '/' || name || '/x' AS clean FROM (SELECT id, string_split(path, '/')[2] AS name FROM paths)")
def path_clean(spark, d):
    """`..` steps go; what they leave are empty steps, which tokens skip."""
    name = F.get(F.split("path", "/"), F.lit(1))
    climbing = F.concat(F.lit("/../"), name, F.lit("/../../x"))
    steps = F.filter(F.split(text.climb_free(climbing), "/"), lambda x: x != "")
    return paths(spark, d).select("id", F.concat(F.lit("/"), F.array_join(steps, "/")).alias("clean"))


@query("open_flags", "SELECT o_orderkey AS id, (o_orderkey & 3) IN (1, 2) AS writes, (o_orderkey & 1024) <> 0 AS appends FROM orders")
def open_flags(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.wants_write(F.col("o_orderkey")).alias("writes"), text.wants_append(F.col("o_orderkey")).alias("appends"))


@query("mutation_file", "SELECT doc_id AS file_id, unnest(range(0, length(text), 97)) AS pos, 'N' AS ch FROM documents")
def mutation_file(spark, d):
    """Packed mutation files, read again."""
    places = docs(spark, d).select("file_id", F.char_length("text").alias("size"), F.when(F.char_length("text") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.char_length("text") - 1) / 97)), lambda k: k * 97)).alias("at"))
    changes = places.select("file_id", "size", F.explode("at").alias("pos"), F.lit("N").alias("ch"))
    return mutations.unpack(mutations.pack(changes))


@query("size_label", "SELECT id, CASE WHEN n < 1025 THEN n || ' B' WHEN n < 1048576 THEN printf('%.2f', floor(n * 100 / 1024.0) / 100) || ' KB' WHEN n < 1073741824 THEN printf('%.2f', floor(n * 100 / 1048576.0) / 100) || ' MB' ELSE printf('%.2f', floor(n * 100 / 1073741824.0) / 100) || ' GB' END AS label FROM (SELECT o_orderkey AS id, o_orderkey * 377 AS n FROM orders)")
def size_label(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.size_label(F.col("o_orderkey") * 377).alias("label"))


@query("config_parse", "SELECT doc_id AS file_id, line_no, name, value FROM (SELECT doc_id, unnest([1, 2, 3]) AS line_no, unnest(['lang', 'source', 'size']) AS name, unnest([lang, source, n_chars::VARCHAR]) AS value FROM documents)")
def config_parse(spark, d):
    rows = table(spark, d, "documents")
    written = F.concat(F.lit("# settings\nlang = "), F.col("lang"), F.lit("  # comment\n  source="), F.col("source"), F.lit("\nsize = "), F.col("n_chars").cast("string"), F.lit("\n"))
    return config.entries(rows.select(F.col("doc_id").alias("file_id"), written.alias("text")))


@query("file_states", f"WITH {_PATHS} SELECT path, CASE WHEN ends_with(path, '.html') THEN 2 ELSE 1 END AS status FROM paths GROUP BY path")
def file_states(spark, d):
    some = paths(spark, d).select("path").distinct()
    events = some.select("path", F.lit("create").alias("event")).union(some.filter(F.col("path").endswith(".html")).select("path", F.lit("release")))
    return catalog.next_state(some.select("path", F.lit(catalog.UNKNOWN).alias("status")), events)


@query("store_roundtrip", f"WITH {_FASTA} SELECT file_id, text FROM fasta")
def store_roundtrip(spark, d):
    """Files encoded against the reference, written as tables, read again and decoded."""
    path = workspace(spark, "store")
    texts = fasta(spark, d)
    ref = any_ref(spark, d, lines.strip(texts))
    files.save_container(texts, ref, path, BLOCK)
    return files.read_back(spark, path, ref)
