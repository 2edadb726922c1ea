"""Scan, parse and sink queries. Scans read files that Spark first writes from the tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgrid.operators import spots as sp, regions as rg
from cellgrid.plans.catalog import query
from cellgrid.plans.q_voxels import SPC_SQL
from cellgrid.sources import scans as sc, sinks as sk

WIDE8 = "select cell_id, " + ", ".join(f"max(value) filter (where gene='g{k:02d}') as g{k:02d}" for k in range(8)) + " from expr group by 1"
G8 = [f"g{k:02d}" for k in range(8)]


def wide(t):
    return t.expr.where(F.col("gene").isin(G8)).groupBy("cell_id").pivot("gene", G8).agg(F.first("value"))


def written(t, df, name):
    path = sk.scratch_path(t.spark, name)
    sk.sink_cells_csv(df, path)
    return path


@query("scan_cells_csv", f"select cell_id::varchar as cell_id, g01, g05 from ({WIDE8})", d="g01 g05")
def _(t):
    return sc.scan_cells_csv(t.spark, written(t, wide(t).withColumnRenamed("cell_id", "Cell ID"), "cells"), ["g01", "g05"])


@query("scan_experiment", f"select 'u'||(cell_id%3) as uid, count(*) as n, sum(g02) as s from ({WIDE8}) group by 1", d="s", i="n")
def _(t):
    root = sk.scratch_path(t.spark, "exp")
    exp = root.split("/")[-1]
    # one folder per uid, file named <exp>_<uid>.csv as the pipeline leaves them
    w = wide(t).withColumn("uid", F.concat(F.lit("u"), F.col("cell_id") % 3)).withColumnRenamed("cell_id", "Cell ID")
    tmp = sk.scratch_path(t.spark, "parts")
    w.repartition("uid").write.partitionBy("uid").option("header", True).csv(tmp)
    fs_rename(t.spark, tmp, root, exp)
    got = sc.scan_experiment(t.spark, root, ["g02"])
    return got.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.sum("g02").alias("s"))


def fs_rename(spark, src: str, root: str, exp: str) -> None:
    """Lay the written parts out as <root>/post/core_output/<uid>/<exp>_<uid>.csv (fixture set-up)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(src).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for d in fs.listStatus(path(src)):
        if not d.isDirectory():
            continue
        uid = d.getPath().getName().split("=")[1]
        out = path(f"{root}/post/core_output/{uid}")
        fs.mkdirs(out)
        for f in fs.listStatus(d.getPath()):
            if f.getPath().getName().startswith("part-"):
                fs.rename(f.getPath(), path(f"{root}/post/core_output/{uid}/{exp}_{uid}.csv"))


@query("union_checked", "select cell_id, gene, value from expr union all select cell_id, gene, value+1 from expr", d="value")
def _(t):
    return sc.union_checked(t.expr, t.expr.withColumn("value", F.col("value") + 1))


@query("scan_mask_qc", "select section, mask_id, z_plane, z_span, principal_plane, assessed, result from mask_qc", i="section mask_id z_plane z_span principal_plane assessed")
def _(t):
    from cellgrid.schema import MASK_QC_HEADER
    back = {v: k for k, v in MASK_QC_HEADER.items()}
    path = written(t, t.mask_qc.withColumnsRenamed(back), "qc")
    return sc.scan_mask_qc(t.spark, path)


@query("scan_bin_calls", "select section, mask_id, gene, positive from bin_calls", i="section mask_id")
def _(t):
    w = t.bin_calls.groupBy("section", F.col("mask_id").alias("Row")).pivot("gene", ["slc5a7", "slc32a1", "slc17a6"]).agg(F.max(F.col("positive").cast("int")))
    return sc.scan_bin_calls(t.spark, written(t, w, "bin"))


@query("scan_atlas_meta", "select cell_id::varchar as cell_label, cluster, subclass, class from meta")
def _(t):
    m = t.meta.withColumnRenamed("cell_id", "cell_label")
    contract = T.StructType([T.StructField(c, T.StringType()) for c in ("cell_label", "cluster", "subclass", "class")])
    return sc.scan_atlas_meta(t.spark, written(t, m, "meta"), contract)


@query("scan_csr_matrix", "select cell_id, substr(gene,2)::int as gene_index, value from expr where value<>0", d="value", i="gene_index")
def _(t):
    return sc.scan_csr_matrix(t.csr_rows)


@query("scan_mapping_results", "select cell_id::varchar as cell_id, class as class_name, subclass as subclass_name from meta")
def _(t):
    cols = [F.col("cell_id").cast("string"), F.col("class").alias("class_name"), F.col("subclass").alias("subclass_name")]
    path = written(t, t.meta.select(*cols), "map")
    # comment lines as the mapper writes them, in a file of their own beside the data
    t.meta.select(F.concat(F.lit("# mapped "), F.col("cell_id")).alias("value")).write.mode("append").text(path)
    return sc.scan_mapping_results(t.spark, path)


@query("matrix_genes_by_rows", f"""select 'cell'||(cell_id%5) as cell_id, 'Sym'||substr(gene,2) as gene, sum(value) as value from expr group by all""", d="value")
def _(t):
    w = t.expr.groupBy(F.col("gene").alias("gene_id")).agg(*[
        F.sum(F.when(F.col("cell_id") % 5 == k, F.col("value"))).alias(f"cell{k}") for k in range(5)])
    sym = t.expr.select(F.col("gene").alias("gene_id"), F.concat(F.lit("Sym"), F.substring("gene", 2, 9)).alias("symbol")).distinct()
    return sc.matrix_genes_by_rows(w, sym)


@query("matrix_cells_by_rows", "select cell_id, gene, value from expr where gene <= 'g07'", d="value")
def _(t):
    return sc.matrix_cells_by_rows(wide(t))


@query("gene_index", "select gene, row_number() over (order by f, gene)-1 as gene_index from (select split(p_name,' ')[1] as gene, min(p_partkey) f from part group by 1)", i="gene_index")
def _(t):
    return sc.gene_index(t.part.select(F.split("p_name", " ")[0].alias("gene"), F.col("p_partkey").alias("pos")))


@query("scan_ontology", "select c_custkey as id, c_name||', '||c_mktsegment as name from customer")
def _(t):
    return sc.scan_ontology(t.customer.select(F.concat(F.col("c_custkey"), F.lit(',"'), F.col("c_name"), F.lit(", "), F.col("c_mktsegment"), F.lit('"')).alias("value")))


@query("scan_run_params", """select o_orderkey as path, case when o_orderkey%2=0 then 3 else 2 end as ndim, o_orderkey%5+0.5::double as first_value,
    o_custkey as iterations from orders""", d="first_value", i="ndim iterations path")
def _(t):
    k = F.col("o_orderkey")
    head = F.concat((k % 5).cast("string"), F.lit(".5"))
    aff = F.concat_ws(" ", head, F.array_join(F.array_repeat(F.lit("1.25"), F.when(k % 2 == 0, 11).otherwise(5)), " "))
    js = t.orders.select(k.alias("path"), F.to_json(F.struct(aff.alias("affine"), F.col("o_custkey").alias("iterations"))).alias("json"))
    return sc.scan_run_params(js).select("path", "ndim", F.col("affine")[0].alias("first_value"), "iterations")


@query("parse_filename", r"""with p as (select path, split(path,'/') s, split(regexp_replace(split(path,'/')[3],'\.[^.]*$',''),'__') n from files),
    c as (select *, split(n[2],'_') ch from p)
    select path, substr(s[1],12) as exp, substr(s[1],1,10)::date as exp_date, regexp_extract(s[2],'_r(\d+)_',1)::int as round, n[1] as uniq_id, n[3] as info,
    k.range as channel_pos, left(ch[k.range+1],len(ch[k.range+1])-3) as gene, right(ch[k.range+1],3)::int as wavelength from c, range(2) k""",
       i="round channel_pos wavelength")
def _(t):
    return sc.parse_filename(t.files)


@query("derive_params", "select '/data/2024-01-0'||(p_partkey%9+1)||'_EXP-'||p_partkey||'/post/core_output/s'||p_size as data_dir, 's'||p_size as uid, 'post' as post_dir, 'EXP-'||p_partkey as experiment from part")
def _(t):
    d = t.part.select(F.concat(F.lit("/data/2024-01-0"), F.col("p_partkey") % 9 + 1, F.lit("_EXP-"), F.col("p_partkey"), F.lit("/post/core_output/s"), F.col("p_size")).alias("data_dir"))
    return sc.derive_params(d)


@query("parse_image_description", """select p_partkey as path, case when p_partkey%3=0 then 1 else p_size end as channels,
    case p_partkey%4 when 0 then p_size+1 when 1 then p_size+2 else 1 end as planes, p_partkey%3<>0 as channels_found, p_partkey%4<2 as planes_found from part""",
       i="path channels planes")
def _(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    txt = F.concat(F.lit("tool=1\n"), F.when(k % 3 != 0, F.concat(F.lit("channels="), s, F.lit("\n"))).otherwise(""),
                   F.when(k % 4 == 0, F.concat(F.lit("slices="), s + 1, F.lit("\nframes=99"))).when(k % 4 == 1, F.concat(F.lit("frames="), s + 2)).otherwise(""))
    return sc.parse_image_description(t.part.select(k.alias("path"), txt.alias("description")))


@query("find_file_by_uid", """with f as (select path, split(split(path,'/')[3],'__')[1] as uid from files union all select path||'x', split(split(path,'/')[3],'__')[1] from files where path like '%p7%')
    select u.uid, min(path) as path from f join (select distinct uid from f) u on contains(split(path,'/')[3], u.uid) group by 1 having count(*)=1""")
def _(t):
    extra = t.files.where("path like '%p7%'").withColumn("path", F.concat("path", F.lit("x")))
    files = t.files.unionByName(extra)
    uids = files.select(F.substring_index(sc.file_name(), "__", 1).alias("uid")).distinct()
    return sc.find_file_by_uid(files, uids)


@query("classify_files", """with n as (select path, lower(split(path,'/')[3]) f from files), k as (select path, case
    when contains(f,'nt') or contains(f,'neur') or contains(f,'snap25') then 'registration' when contains(f,'bin') then 'binary'
    when contains(f,'final_qc_masks') or contains(f,'uncurated_masks') then 'mask' when contains(f,'masks_qc_final') or contains(f,'cp_masks') then 'mask_image'
    when contains(f,'.tif') then 'data' else 'other' end as kind, f from n)
    select path, kind, case when kind not in ('mask','mask_image') then null else f not like '%uncurated_masks%' and f not like '%cp_masks%' or f like '%final_qc_masks%' end as curated from k""")
def _(t):
    return sc.classify_files(t.files)


@query("sink_cells_csv", SPC_SQL, i="A N R section mask_id")
def _(t):
    pp = rg.principal_plane_masks(t.masks, t.good_cells)
    cells = sp.spots_per_cell(t.spots, pp, t.good_cells, ["A", "N", "R"])
    return t.spark.read.option("header", True).csv(written(t, cells, "matrix"))


@query("sink_mapper_input", "select cell_id, 'G'||substr(gene,2) as gene, value::int as count from expr", i="count")
def _(t):
    path = sk.scratch_path(t.spark, "mapper")
    sk.sink_mapper_input(t.expr, path)
    return t.spark.read.parquet(path)


#: limits that cut the small tables, too
ROWS_LIMIT, TEXT_LIMIT = 1000, 1 << 18


@query("sink_split_by_size", f"""with b as (select vec_id, 8 + if(label is null, 0, 4) as w from embeddings),
    r as (select vec_id, row_number() over (order by vec_id) rn, count(*) over () n, ceil(sum(w) over ()/{ROWS_LIMIT})::bigint k from b)
    select least((rn-1)//(n//k), k-1) as part, count(*) as n, min(vec_id) as first_id, max(vec_id) as last_id from r group by 1""", i="part n first_id last_id")
def _(t):
    path = sk.scratch_path(t.spark, "split")
    sk.sink_split_by_size(t.embeddings.select("vec_id", "label"), "vec_id", ROWS_LIMIT, path)
    return t.spark.read.parquet(path).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


@query("sink_split_by_bytes", f"""with b as (select doc_id, 8 + coalesce(strlen(lang), 0) + coalesce(strlen(text), 0) as w from documents),
    s as (select doc_id, w, sum(w) over (order by doc_id rows unbounded preceding) upto, max(w) over () top from b)
    select greatest((upto-1)//({TEXT_LIMIT}-top), 0) as part, count(*) as n, sum(w) as bytes, min(doc_id) as first_id, max(doc_id) as last_id
    from s group by 1""", i="part n bytes first_id last_id")
def _(t):
    """Parts of texts of any length, none over the limit."""
    path = sk.scratch_path(t.spark, "split")
    sk.sink_split_by_bytes(t.documents.select("doc_id", "lang", "text"), "doc_id", TEXT_LIMIT, path)
    back = t.spark.read.parquet(path)
    return back.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(sk.row_bytes(back.drop("part"))).alias("bytes"),
                                    F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
