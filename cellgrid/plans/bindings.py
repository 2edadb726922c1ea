"""Views of the star-schema tables as imaging fixtures, in Spark and in DuckDB SQL.

Every fixture is keyed by something that grows with the tables (section = supplier
block, cell = vector, file = part ...), so the work of each query grows with its input.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.operators import voxels as vox
from cellgrid.session import join_where_dealt

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
NZ, NY, NX = 7, 32, 32
GENES = ["slc5a7", "slc32a1", "slc17a6"]
UNMIX = [("A", "N", 5.0, 0.3, True), ("N", "R", 0.0, 0.2, True), ("R", "A", 0.0, 0.5, False)]
SHIFTS = [("A", 1, 0), ("N", 0, -2), ("R", -1, 1)]


class Inputs:
    """Driver tables and fixtures of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        join_where_dealt(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    def rows(self, rows, schema) -> DataFrame:
        """A parameter table (not query input)."""
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def voxels(self):
        return (self.lineitem.groupBy(
            F.floor(F.col("l_suppkey") / 4).cast("int").alias("section"), F.col("l_returnflag").alias("channel"),
            (F.col("l_linenumber") - 1).cast("int").alias("z"), (F.col("l_orderkey") % NY).cast("int").alias("y"),
            (F.col("l_partkey") % NX).cast("int").alias("x")).agg(F.sum("l_quantity").alias("v")))

    @cached_property
    def volumes(self):
        return (self.lineitem.select(F.floor(F.col("l_suppkey") / 4).cast("int").alias("section"),
                                     F.col("l_returnflag").alias("channel")).distinct()
                .select("section", "channel", F.lit(NZ).alias("n_z"), F.lit(NY).alias("n_y"), F.lit(NX).alias("n_x")))

    @cached_property
    def sections(self):
        return self.volumes.select("section", "n_z", "n_y", "n_x").distinct()

    @cached_property
    def dense(self):
        floor = 40 - 3 * F.col("z") + (F.col("x") * 7 + F.col("y") * 13 + F.col("z")) % 11
        return vox.densify(self.voxels, self.volumes).withColumn("v", F.col("v") + floor)

    @cached_property
    def masks(self):
        grid = vox.grid(self.sections)
        m = F.floor(F.col("y") / 8) * 4 + F.floor(F.col("x") / 8) + 1
        yy, xx = F.col("y") % 8 - 4, F.col("x") % 8 - 4
        return (grid.withColumn("mask_id", m.cast("int"))
                .where((yy * yy + xx * xx <= 9) & (F.col("z") >= F.col("mask_id") % 4)
                       & (F.col("z") <= F.col("mask_id") % 4 + F.col("mask_id") % 3))
                .select("section", "mask_id", "z", "y", "x"))

    @cached_property
    def mask_qc(self):
        m = F.col("mask_id")
        s = m + F.col("section")
        return (self.masks.select("section", "mask_id").distinct()
                .select("section", "mask_id", (m % 4 + 1).alias("z_plane"), (m % 3 + 1).alias("z_span"),
                        (m % (m % 3 + 1) + 1).alias("principal_plane"),
                        F.when(s % 5 == 0, 0).otherwise(1).alias("assessed"),
                        F.when(s % 7 == 0, "bad").otherwise("good").alias("result")))

    @cached_property
    def bin_calls(self):
        m = F.col("mask_id")
        return self.mask_qc.select("section", "mask_id", F.explode(F.array(*[
            F.struct(F.lit(g).alias("gene"), ((m + F.col("section")) % k == 0).alias("positive"))
            for g, k in zip(GENES, (3, 4, 2))])).alias("c")).select("section", "mask_id", "c.*")

    @cached_property
    def spots(self):
        return self.voxels.where("v > 20").withColumnRenamed("channel", "gene")

    @cached_property
    def good_cells(self):
        return self.mask_qc.where("assessed = 1 and result = 'good'")

    @cached_property
    def csr_rows(self):
        v = F.transform("embedding", lambda e: F.floor(F.abs(e.cast("double")) * 100).cast("double"))
        return (self.embeddings.select(F.col("vec_id").alias("cell_id"), v.alias("v"))
                .select("cell_id", F.filter(F.transform("v", lambda e, i: F.struct(i.alias("i"), e.alias("d"))),
                                            lambda s: s["d"] != 0).alias("nz"))
                .select("cell_id", F.col("nz.i").alias("indices"), F.col("nz.d").alias("data")))

    @cached_property
    def expr(self):
        return self.embeddings.select(F.col("vec_id").alias("cell_id"), F.posexplode("embedding").alias("p", "e")).select(
            "cell_id", F.concat(F.lit("g"), F.lpad(F.col("p").cast("string"), 2, "0")).alias("gene"),
            F.floor(F.abs(F.col("e").cast("double")) * 100).cast("double").alias("value"))

    @cached_property
    def meta(self):
        lab = F.col("label")
        return self.embeddings.select(
            F.col("vec_id").alias("cell_id"), F.concat(F.lit("c"), lab).alias("cluster"),
            F.concat(F.lit("t"), lab).alias("supertype"), F.concat(F.lit("s"), F.floor(lab / 2)).alias("subclass"),
            F.concat(F.lit("k"), F.floor(lab / 4)).alias("class"),
            F.concat(F.lit("m"), F.col("vec_id") % 4).alias("feature_matrix_label"),
            F.concat(F.lit("org"), F.col("vec_id") % 2).alias("organ"),
            F.concat(F.lit("cat"), F.col("vec_id") % 3).alias("category"),
            F.concat(F.lit("div"), F.col("vec_id") % 5).alias("division"),
            F.concat(F.lit("str"), F.col("vec_id") % 7).alias("structure"),
            F.concat(F.lit("sub"), F.col("vec_id") % 11).alias("substructure"))

    @cached_property
    def taxonomy(self):
        return self.meta.select("cluster", "supertype", "subclass", "class").distinct()

    @cached_property
    def freqs(self):
        return self.embeddings.select("label").distinct().select(
            F.concat(F.lit("c"), F.col("label")).alias("type"), ((F.col("label") + 1) / F.lit(55.0)).alias("p"))

    @cached_property
    def curve(self):
        from cellgrid.operators import spots
        values = self.events.select(F.col("event_type").alias("gene"), (F.col("user_id") % 4).cast("int").alias("z"),
                                    F.col("value").alias("v"))
        return spots.spot_count_curve(values, 0.0, 3.0, 100, keys=["gene", "z"])

    @cached_property
    def fiducials(self):
        k = F.col("c_custkey")
        mx, my, mz = (k % 97).cast("double"), (k % 89).cast("double"), (k % 7).cast("double")
        e = F.col("c_acctbal") / 1e6
        return self.customer.select(
            F.col("c_nationkey").alias("section"), k.alias("pt_id"), mx.alias("mx"), my.alias("my"), mz.alias("mz"),
            (mx * 1.02 + my * 0.03 - mz * 0.01 + 4.0 + e).alias("fx"),
            (my * 0.98 - mx * 0.02 + mz * 0.05 - 3.0 - e).alias("fy"),
            (mz * 1.1 + mx * 0.001 + my * 0.002 + 0.5 + e).alias("fz"))

    @cached_property
    def annotation(self):
        return vox.grid(self.sections).select(
            "section", "z", "y", "x",
            ((F.floor(F.col("y") / 8) * 4 + F.floor(F.col("x") / 8) + F.col("section")) % 25).cast("int").alias("parc_id"))

    @cached_property
    def parc_terms(self):
        return (self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
                .select(F.col("n_nationkey").alias("parcellation_index"), F.col("n_name").alias("structure"),
                        F.col("r_name").alias("division")))

    @cached_property
    def files(self):
        k, words = F.col("p_partkey"), F.split("p_name", " ")
        return self.part.select(F.concat(
            F.lit("2024-12-20_EXP-"), k % 3, F.lit("/2024-12-2"), k % 4, F.lit("_r"), k % 4, F.lit("_HCR/s"),
            F.lpad((k % 10).cast("string"), 2, "0"), F.lit("p"), k, F.lit("__"), words[0], F.lit("488_"), words[1],
            F.lit("594__"), F.element_at(F.array(*[F.lit(s) for s in (
                "HCR.tif", "uncurated_masks.csv", "Binary.csv", "NT.tif", "masks_qc_final.nii", "final_qc_masks.csv")]),
                (k % 6 + 1).cast("int"))).alias("path"))

    @cached_property
    def work_log(self):
        return self.orders.select(
            F.concat(F.lit("f"), F.floor(F.col("o_orderkey") / 4)).alias("path"),
            F.element_at(F.array(F.lit("stitch"), F.lit("unmix"), F.lit("register"), F.lit("quantify")),
                         (F.col("o_orderkey") % 4 + 1).cast("int")).alias("operation"),
            (F.col("o_orderkey") % 11 != 0).alias("enabled"), (F.col("o_orderstatus") == "F").alias("done"))


#: fixed values: the same fixtures for the SQL oracle
SQL = {
    "voxels": f"""select (l_suppkey//4)::int as section, l_returnflag as channel, (l_linenumber-1)::int as z,
        (l_orderkey%{NY})::int as y, (l_partkey%{NX})::int as x, sum(l_quantity) as v from lineitem group by all""",
    "volumes": f"""select distinct (l_suppkey//4)::int as section, l_returnflag as channel, {NZ} as n_z, {NY} as n_y,
        {NX} as n_x from lineitem""",
    "sections": "select distinct section, n_z, n_y, n_x from volumes",
    "grid3": "select s.section, gz.range::int as z, gy.range::int as y, gx.range::int as x, n_z, n_y, n_x from sections s, "
             f"range({NZ}) gz, range({NY}) gy, range({NX}) gx",
    "dense": f"""select g.section, p.channel, g.z, g.y, g.x, p.n_z, p.n_y, p.n_x,
        coalesce(v.v,0) + 40 - 3*g.z + (g.x*7+g.y*13+g.z)%11 as v
        from grid3 g join volumes p using (section) left join voxels v
        on v.section=g.section and v.channel=p.channel and v.z=g.z and v.y=g.y and v.x=g.x""",
    "masks": """select section, (y//8)*4 + x//8 + 1 as mask_id, z, y, x from grid3
        where (y%8-4)*(y%8-4)+(x%8-4)*(x%8-4) <= 9
        and z between ((y//8)*4 + x//8 + 1)%4 and ((y//8)*4 + x//8 + 1)%4 + ((y//8)*4 + x//8 + 1)%3""",
    "mask_qc": """select section, mask_id, mask_id%4+1 as z_plane, mask_id%3+1 as z_span,
        mask_id%(mask_id%3+1)+1 as principal_plane, case when (mask_id+section)%5=0 then 0 else 1 end as assessed,
        case when (mask_id+section)%7=0 then 'bad' else 'good' end as result
        from (select distinct section, mask_id from masks)""",
    "bin_calls": """select section, mask_id, gene, (mask_id+section)%k=0 as positive from mask_qc,
        (values ('slc5a7',3),('slc32a1',4),('slc17a6',2)) g(gene,k)""",
    "spots": "select section, channel as gene, z, y, x, v from voxels where v > 20",
    "good_cells": "select * from mask_qc where assessed = 1 and result = 'good'",
    "emb": """select vec_id, label, unnest(embedding)::double as e, generate_subscripts(embedding,1)-1 as p
        from embeddings""",
    "expr": """select vec_id as cell_id, 'g'||lpad(p::varchar,2,'0') as gene, floor(abs(e)*100) as value from emb""",
    "csr_rows": """select cell_id, list(substr(gene,2)::int order by gene) as indices, list(value order by gene) as data
        from expr where value<>0 group by cell_id""",
    "meta": """select vec_id as cell_id, 'c'||label as cluster, 't'||label as supertype, 's'||(label//2) as subclass,
        'k'||(label//4) as class, 'm'||(vec_id%4) as feature_matrix_label, 'org'||(vec_id%2) as organ,
        'cat'||(vec_id%3) as category, 'div'||(vec_id%5) as division, 'str'||(vec_id%7) as structure,
        'sub'||(vec_id%11) as substructure from embeddings""",
    "taxonomy": "select distinct cluster, supertype, subclass, class from meta",
    "freqs": "select distinct 'c'||label as type, (label+1)/55.0::double as p from embeddings",
    "curve": """select gene, z, thr.range*3.0::double as thr, count(*) filter (where v > thr.range*3.0) as n
        from (select event_type as gene, (user_id%4)::int as z, value as v from events), range(100) thr group by all""",
    "fiducials": """select c_nationkey as section, c_custkey as pt_id, mx, my, mz,
        mx*1.02::double + my*0.03::double - mz*0.01::double + 4 + c_acctbal/1e6 as fx,
        my*0.98::double - mx*0.02::double + mz*0.05::double - 3 - c_acctbal/1e6 as fy,
        mz*1.1::double + mx*0.001::double + my*0.002::double + 0.5::double + c_acctbal/1e6 as fz
        from (select *, (c_custkey%97)::double as mx, (c_custkey%89)::double as my, (c_custkey%7)::double as mz from customer)""",
    "annotation": "select section, z, y, x, ((y//8)*4 + x//8 + section)%25 as parc_id from grid3",
    "parc_terms": """select n_nationkey as parcellation_index, n_name as structure, r_name as division
        from nation join region on n_regionkey=r_regionkey""",
    "files": """select '2024-12-20_EXP-'||(p_partkey%3)||'/2024-12-2'||(p_partkey%4)||'_r'||(p_partkey%4)||'_HCR/s'
        ||lpad((p_partkey%10)::varchar,2,'0')||'p'||p_partkey||'__'||split(p_name,' ')[1]||'488_'||split(p_name,' ')[2]
        ||'594__'||(['HCR.tif','uncurated_masks.csv','Binary.csv','NT.tif','masks_qc_final.nii','final_qc_masks.csv'])[p_partkey%6+1]
        as path from part""",
    "work_log": """select 'f'||(o_orderkey//4) as path, (['stitch','unmix','register','quantify'])[o_orderkey%4+1] as operation,
        o_orderkey%11<>0 as enabled, o_orderstatus='F' as done from orders""",
}


def with_bindings(sql: str) -> str:
    """Prefix ``sql`` with the fixture definitions it mentions, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in SQL.items():
            if name not in needed and re.search(rf"\b(from|join|,)\s+{name}\b", text, re.I):
                visit(body)
                needed.append(name)

    visit(sql)
    order = [n for n in SQL if n in needed]
    if not order:
        return sql
    own = re.match(r"\s*with\s+(recursive\s+)?", sql, re.I)
    rest = sql[own.end():] if own else None
    head = "WITH " + ("RECURSIVE " if own and own.group(1) else "")
    head += ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    return f"{head},\n{rest}" if own else f"{head}\n{sql}"
