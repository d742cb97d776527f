"""Queries of the variant operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import variants as V
from . import domain as D

Q: dict = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = (f, sql)
        return f

    return add


ALLELE_ROWS = """SELECT l_partkey % 5 + 1 AS chrom, l_partkey * 1000 AS pos,
    CASE WHEN l_linenumber <> 7 THEN (l_linenumber % 2)::BIGINT END AS a0,
    CASE WHEN l_linenumber < 6 THEN ((l_linenumber // 2) % 2)::BIGINT END AS a1 FROM lineitem"""


def allele_rows(s, d):
    n = F.col("l_linenumber")
    return D.table(s, d, "lineitem").select(
        (F.col("l_partkey") % 5 + 1).alias("chrom"), (F.col("l_partkey") * 1000).alias("pos"),
        F.when(n != 7, (n % 2).cast("long")).alias("a0"), F.when(n < 6, (F.floor(n / 2) % 2).cast("long")).alias("a1"),
    )


@query(f"""SELECT chrom, pos, (count(*) FILTER (WHERE a0 > 0) + count(*) FILTER (WHERE a1 > 0)) AS ac, count(a0) + count(a1) AS an
FROM ({ALLELE_ROWS}) GROUP BY chrom, pos""")
def allele_counts(s, d):
    return V.allele_counts(allele_rows(s, d))


# Records before splitting: one a shipment, with bases from part and line.
RECORDS = """SELECT l_partkey % 5 + 1 AS chrom, (l_partkey // 4) * 1000 AS pos, substr('ACGT', ((l_partkey // 4) % 4 + 1)::INT, 1) AS ref,
    substr('ACGT', ((l_partkey // 4 + l_partkey % 4) % 4 + 1)::INT, 1) AS alt FROM lineitem"""


def records(s, d):
    k = F.floor(F.col("l_partkey") / 4)
    pick = lambda e: F.substr(F.lit("ACGT"), (e % 4 + 1).cast("int"), F.lit(1))
    return D.table(s, d, "lineitem").select((F.col("l_partkey") % 5 + 1).alias("chrom"), (k * 1000).alias("pos"), pick(k).alias("ref"), pick(k + F.col("l_partkey") % 4).alias("alt"))


@query(f"""WITH r AS (SELECT DISTINCT * FROM ({RECORDS})),
n AS (SELECT chrom, pos, count(DISTINCT a) AS orig_nalleles FROM (SELECT chrom, pos, ref AS a FROM r UNION ALL SELECT chrom, pos, alt FROM r) GROUP BY ALL),
f AS (SELECT chrom, pos, count(DISTINCT ref) = 1 AS single_ref FROM r GROUP BY ALL)
SELECT r.chrom, r.pos, ref, alt, orig_nalleles, single_ref FROM r JOIN n USING (chrom, pos) JOIN f USING (chrom, pos)""")
def original_alleles(s, d):
    return V.mark_original_alleles(records(s, d).distinct())


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY alt) AS k FROM (SELECT DISTINCT * FROM ({RECORDS}) WHERE ref <> alt)),
m AS (SELECT chrom, pos, ref, count(*) AS n FROM r GROUP BY ALL)
SELECT r.chrom, r.pos, r.ref, r.alt, CASE WHEN m.n >= 1 AND r.k = 1 THEN 1 ELSE 0 END::BIGINT AS a0, CASE WHEN r.k = m.n THEN 1 ELSE 0 END::BIGINT AS a1 FROM r JOIN m USING (chrom, pos)""")
def split_multiallelic(s, d):
    """Every site's alts in order, with a genotype of its first and last alt."""
    site = records(s, d).filter("ref <> alt").groupBy("chrom", "pos", "ref").agg(F.array_sort(F.collect_set("alt")).alias("alts"))
    return V.split_multiallelic(site.withColumns({"a0": F.lit(1), "a1": F.size("alts")}))


@query(f"""WITH {D.SITES} SELECT chrom, pos, ref, alt, ac, an FROM sites
WHERE an > 0 AND least(ac, an - ac) * 5 <= 2 * an AND ref <> alt""")
def filter_snv(s, d):
    return V.filter_snv(D.sites(s, d), (2, 5)).select("chrom", "pos", "ref", "alt", "ac", "an")


@query(f"""WITH {D.SITES}
SELECT 'raw' AS stage, chrom, count(*) AS n FROM sites GROUP BY chrom
UNION ALL SELECT 'called', chrom, count(*) FROM sites WHERE an > 0 GROUP BY chrom
UNION ALL SELECT 'rare', chrom, count(*) FROM sites WHERE an > 0 AND least(ac, an - ac) * 5 <= 2 * an GROUP BY chrom""")
def stage_counts(s, d):
    x = D.sites(s, d)
    return V.stage_counts({"raw": x, "called": x.filter("an > 0"), "rare": V.filter_snv(x, (2, 5))})


REASON = """CASE WHEN an = 0 THEN 'all_missing' WHEN 2 * ac = an THEN 'frequency_tie' WHEN least(ac, an - ac) < 2 THEN 'mac_below_min'
  WHEN least(ac, an - ac) * 5 > 2 * an THEN 'maf_above_max' ELSE 'included' END"""
RARE = dict(max_num=2, max_den=5, min_mac=2)  # the tables' sites are seldom rarer


def one_alt(s, d):
    return D.sites(s, d).withColumn("orig_nalleles", F.lit(2))


@query(f"""WITH {D.SITES} SELECT chrom, pos, ref, alt, (2 * ac < an)::BIGINT AS rare_allele, least(ac, an - ac) AS rare_ac, an AS rare_an, least(ac, an - ac) / an AS rare_af
FROM sites WHERE {REASON} = 'included'""")
def select_rare_minor(s, d):
    return V.select_rare_minor(one_alt(s, d), **RARE).select("chrom", "pos", "ref", "alt", "rare_allele", "rare_ac", "rare_an", "rare_af")


@query(f"WITH {D.SITES} SELECT {REASON} AS reason, count(*) AS n FROM sites GROUP BY 1")
def rare_exclusions(s, d):
    return V.rare_exclusions(one_alt(s, d), **RARE)


@query(f"""WITH {D.SITES}, m AS (SELECT geno.*, ac, an FROM geno JOIN sites USING (chrom, pos) WHERE dosage IS NOT NULL)
SELECT 'historical_alt' AS mode, chrom, count(*) AS n, count(DISTINCT sample_id) AS n_people FROM m WHERE dosage > 0 GROUP BY chrom
UNION ALL SELECT 'minor_allele', chrom, count(*), count(DISTINCT sample_id) FROM m WHERE (2 * ac > an AND dosage < 2) OR (2 * ac < an AND dosage > 0) GROUP BY chrom
UNION ALL SELECT 'exclude_alt_major', chrom, count(*), count(DISTINCT sample_id) FROM m WHERE dosage > 0 AND 2 * ac <= an GROUP BY chrom""")
def carrier_modes(s, d):
    g, x = D.genotypes(s, d), D.sites(s, d)
    out = None
    for mode in ("historical_alt", "minor_allele", "exclude_alt_major"):
        part = V.carriers(g, x, mode).groupBy("chrom").agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("n_people")).select(F.lit(mode).alias("mode"), "chrom", "n", "n_people")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {D.SITES}, r AS (SELECT chrom, pos, 2 * ac < an AS alt FROM sites WHERE {REASON} = 'included'),
c AS (SELECT sample_id, chrom, pos, CASE WHEN alt THEN dosage ELSE 2 - dosage END AS rare_dosage FROM geno JOIN r USING (chrom, pos))
SELECT * FROM c WHERE rare_dosage > 0""")
def source_minor_carriers(s, d):
    return V.source_minor_carriers(D.genotypes(s, d), V.select_rare_minor(one_alt(s, d), **RARE))


@query(f"""WITH {D.SITES}, f AS (SELECT chrom, pos, coalesce(sum(dosage), 0)::BIGINT AS ac, 2 * count(dosage) AS an FROM geno JOIN customer ON c_custkey = sample_id WHERE c_mktsegment = 'BUILDING' GROUP BY ALL),
j AS (SELECT s.chrom, s.pos, s.ac, s.an, coalesce(f.ac, 0) AS sac, coalesce(f.an, 0) AS san FROM sites s LEFT JOIN f ON f.chrom = s.chrom AND f.pos = s.pos)
SELECT CASE WHEN an = 0 THEN 'all_missing' WHEN 2 * ac = an THEN 'tie' WHEN 2 * ac > an THEN 'alt_major' ELSE 'alt_minor' END AS cohort_state,
  CASE WHEN san = 0 THEN 'all_missing' WHEN 2 * sac = san THEN 'tie' WHEN 2 * sac > san THEN 'alt_major' ELSE 'alt_minor' END AS subset_state, count(*) AS n
FROM j GROUP BY ALL""")
def orientation_inventory(s, d):
    """Orientation in the whole cohort against the people of one market segment."""
    part = D.table(s, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("sample_id"))
    sub = D.genotypes(s, d).join(part, "sample_id").groupBy("chrom", "pos").agg(F.coalesce(F.sum("dosage"), F.lit(0)).alias("sac"), (2 * F.count("dosage")).alias("san"))
    j = D.sites(s, d).join(sub, ["chrom", "pos"], "left").withColumns({"sac": F.coalesce("sac", F.lit(0)), "san": F.coalesce("san", F.lit(0))})
    return j.groupBy(V.orientation_state().alias("cohort_state"), V.orientation_state("sac", "san").alias("subset_state")).agg(F.count("*").alias("n"))


# Reference sequence: 1000 bases a chunk, base k of chunk c is letter (c * 7 + k * k) modulo 4; sites stand at pos modulo 100000.
CHUNK = 1000


def reference(s, d):
    chroms = D.table(s, d, "part").select((F.col("p_partkey") % 5 + 1).alias("chrom")).distinct()
    c = chroms.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(89).cast("long"))).alias("c"))
    letter = F.transform(F.sequence(F.lit(0), F.lit(CHUNK - 1)), lambda k: F.substr(F.lit("ACGT"), ((F.col("c") * 7 + k * k) % 4 + 1).cast("int"), F.lit(1)))
    return c.select("chrom", (F.col("c") * CHUNK + 1).alias("chunk_start"), F.array_join(letter, "").alias("bases"))


def small_sites(s, d):
    return D.sites(s, d).withColumn("pos", F.col("pos") * 7 % 100_000 + 1).dropDuplicates(["chrom", "pos", "ref", "alt"]).select("chrom", "pos", "ref", "alt")


def _base(at: str) -> str:
    return f"(CASE WHEN {at} BETWEEN 1 AND 90000 THEN substr('ACGT', (((({at}) - 1) // 1000 * 7 + ((({at}) - 1) % 1000) * ((({at}) - 1) % 1000)) % 4 + 1)::INT, 1) END)"


SMALL = f"WITH {D.SITES}, t AS (SELECT DISTINCT chrom, pos * 7 % 100000 + 1 AS pos, ref, alt FROM sites)"


@query(f"""{SMALL}, x AS (SELECT *, {_base('pos - 1')} AS before, {_base('pos + 1')} AS after FROM t)
SELECT chrom, pos, ref, alt, before || ref || after AS context,
  CASE WHEN ref || alt NOT IN ('AG', 'GA', 'CT', 'TC') THEN 'transversion'
    WHEN (ref = 'C' AND coalesce(after, '') = 'G') OR (ref = 'G' AND coalesce(before, '') = 'C') THEN 'cpg_ti' ELSE 'noncpg_ti' END AS class
FROM x""")
def mutation_context(s, d):
    r = reference(s, d)
    x = V.base_at(V.base_at(small_sites(s, d), r, CHUNK, -1, "before"), r, CHUNK, 1, "after")
    return x.select("chrom", "pos", "ref", "alt", F.concat("before", "ref", "after").alias("context"), V.mutation_class().alias("class"))


@query(f"""{SMALL}, x AS (SELECT *, {_base('pos')} AS ancestral FROM t)
SELECT chrom, pos, ref, alt, ancestral, CASE WHEN ancestral = ref THEN 'ok_ref' WHEN ancestral = alt THEN 'ok_alt' ELSE 'mismatch' END AS status,
  coalesce(ancestral <> ref AND ancestral = alt, false) AS flip FROM x""")
def polarise(s, d):
    return V.polarise(small_sites(s, d), reference(s, d), CHUNK).select("chrom", "pos", "ref", "alt", "ancestral", "status", "flip")


@query(f"""{SMALL}, x AS (SELECT *, {_base('pos')} AS base FROM t)
SELECT chrom, count(*) AS n, count(*) FILTER (WHERE base = ref) AS n_match, count(*) FILTER (WHERE base <> ref) AS n_mismatch, count(*) FILTER (WHERE base IS NULL) AS n_outside
FROM x GROUP BY chrom""")
def reference_audit(s, d):
    return V.reference_audit(small_sites(s, d), reference(s, d), CHUNK)


@query(f"""WITH {D.SITES}, p AS (
  SELECT chrom, pos, list_sort([ref, alt]) AS x,
    list_sort([translate(o1, 'ACGT', 'ACGT'), o2]) AS y, list_sort([translate(o1, 'ACGT', 'TGCA'), translate(o2, 'ACGT', 'TGCA')]) AS z
  FROM (SELECT *, substr('ACGT', ((pos // 7000) % 4 + 1)::INT, 1) AS o1, substr('ACGT', ((pos // 7000 + 1 + (pos // 3000) % 3) % 4 + 1)::INT, 1) AS o2 FROM sites))
SELECT CASE WHEN x = y AND y = z THEN 'palindromic_ambiguous' WHEN x = y THEN 'direct' WHEN x = z THEN 'complement' ELSE 'mismatch' END AS verdict, count(*) AS n
FROM p GROUP BY 1""")
def allele_correspondence(s, d):
    pick = lambda e: F.substr(F.lit("ACGT"), (e % 4 + 1).cast("int"), F.lit(1))
    k = F.floor(F.col("pos") / 7000)
    x = D.sites(s, d).withColumns({"o1": pick(k), "o2": pick(k + 1 + F.floor(F.col("pos") / 3000) % 3)})
    return x.groupBy(V.allele_correspondence("ref", "alt", "o1", "o2").alias("verdict")).agg(F.count("*").alias("n"))


@query(f"""WITH {D.SITES}, r AS (SELECT DISTINCT * FROM ({RECORDS}) WHERE ref <> alt),
p AS (SELECT chrom, pos, ref, list(alt) AS alts FROM r GROUP BY ALL),
j AS (SELECT s.chrom, s.pos, s.ref, s.alt, count(*) FILTER (WHERE p.ref = s.ref AND list_contains(p.alts, s.alt)) AS n_compatible,
    coalesce(max(len(p.alts)) FILTER (WHERE p.ref = s.ref AND list_contains(p.alts, s.alt)), 0) AS k, count(p.ref) AS n_records
  FROM sites s LEFT JOIN p ON p.chrom = s.chrom AND p.pos = s.pos GROUP BY ALL)
SELECT chrom, pos, ref, alt, n_compatible, n_records,
  CASE WHEN n_compatible > 0 AND k = 1 THEN 'exact' WHEN n_compatible > 0 THEN 'multiallelic' WHEN n_records > 0 THEN 'position_only' ELSE 'absent' END AS state FROM j""")
def choose_record(s, d):
    panel = records(s, d).filter("ref <> alt").groupBy("chrom", "pos", "ref").agg(F.collect_set("alt").alias("alts"))
    return V.choose_record(D.sites(s, d), panel)


@query("""SELECT l_returnflag AS flag, CASE WHEN dp IS NULL THEN 'missing' WHEN dp >= 10 AND gq >= 20 THEN 'pass' ELSE 'failed' END AS state, count(*) AS n
FROM (SELECT l_returnflag, CASE WHEN l_linenumber <> 7 THEN l_quantity END AS dp, l_extendedprice / 1000 AS gq FROM lineitem) GROUP BY ALL""")
def quality_state(s, d):
    x = D.table(s, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("dp"), (F.col("l_extendedprice") / 1000).alias("gq"))
    return x.groupBy("flag", V.quality_state("dp", "gq", 10, 20).alias("state")).agg(F.count("*").alias("n"))


@query(f"""WITH {D.GENO}, m AS (SELECT chrom * 100000 + pos // 20000 AS block, pos AS marker, dosage AS allele FROM geno),
p AS (SELECT block, marker, count(DISTINCT allele) AS k, max(allele) AS top FROM m WHERE allele IS NOT NULL GROUP BY ALL),
b AS (SELECT block, count(*) AS n_called, max(k) AS k, max(top) AS top FROM p GROUP BY block)
SELECT a.block, coalesce(n_called, 0) AS n_called, CASE WHEN coalesce(n_called, 0) < 2 THEN 'UNEVALUABLE_FEW' WHEN k > 1 THEN 'UNEVALUABLE_CONFLICT' WHEN top > 0 THEN 'PRESENT' ELSE 'ABSENT' END AS state
FROM (SELECT DISTINCT block FROM m) a LEFT JOIN b USING (block)""")
def block_state(s, d):
    m = D.genotypes(s, d).select((F.col("chrom") * 100000 + F.floor(F.col("pos") / 20000)).alias("block"), F.col("pos").alias("marker"), F.col("dosage").alias("allele"))
    return V.block_state(m, "block", "marker", "allele", 2)


@query(f"""WITH {D.SITES}, r AS (
  SELECT l_partkey % 5 + 1 AS chrom, l_partkey * 1000 - 1500 AS lo, l_partkey * 1000 + (l_quantity * 40)::BIGINT AS hi,
    CASE WHEN l_linenumber < 3 THEN 'A' END AS ref, CASE WHEN l_linenumber < 3 THEN 'T' END AS alt,
    CASE WHEN l_linenumber <> 7 THEN 0 END AS dosage, l_quantity AS dp, l_extendedprice / 1000 AS gq
  FROM lineitem),
j AS (SELECT s.chrom, s.pos, s.ref, s.alt, (dp >= 8 AND gq >= 20 AND dosage IS NOT NULL) AS good, r.ref AS rr, r.alt AS ra, r.lo, dosage
  FROM sites s JOIN r ON r.chrom = s.chrom AND s.pos BETWEEN r.lo AND r.hi),
p AS (SELECT chrom, pos, ref, alt, min(CASE WHEN good AND ra IS NOT NULL AND dosage = 0 THEN 2 WHEN good AND ra IS NULL THEN 3 WHEN NOT good THEN 4 ELSE 5 END) AS place FROM j GROUP BY ALL)
SELECT s.chrom, s.pos, s.ref, s.alt, CASE place WHEN 2 THEN 'other_alt_hom_ref' WHEN 3 THEN 'reference_block' WHEN 4 THEN 'missing' WHEN 5 THEN 'incompatible' ELSE 'uncovered' END AS state,
  CASE WHEN place <= 3 THEN 0 END::BIGINT AS dosage
FROM sites s LEFT JOIN p ON p.chrom = s.chrom AND p.pos = s.pos AND p.ref = s.ref AND p.alt = s.alt""")
def gvcf_state(s, d):
    """Sites against blocks around the shipped parts (no block starts at a site)."""
    first = F.col("l_linenumber") < 3
    r = D.table(s, d, "lineitem").select(
        (F.col("l_partkey") % 5 + 1).alias("chrom"), (F.col("l_partkey") * 1000 - 1500).alias("lo"), (F.col("l_partkey") * 1000 + F.col("l_quantity") * 40).cast("long").alias("hi"),
        F.when(first, "A").alias("ref"), F.when(first, "T").alias("alt"), F.when(F.col("l_linenumber") != 7, 0).alias("dosage"), F.col("l_quantity").alias("dp"), (F.col("l_extendedprice") / 1000).alias("gq"),
    )
    return V.classify_gvcf(D.sites(s, d).select("chrom", "pos", "ref", "alt"), r)
