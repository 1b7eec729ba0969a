"""Files in and out; simulated reads give back the proportions they came from; partitioning changes nothing."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandweave.functions import paths as P
from strandweave.operators import readpaths as R
from strandweave.plans.thorough import Options, simulate, thorough
from strandweave.sources import readers, writers
from strandweave.streaming.readpaths import count_paths_stream

GFA = "H\tVN:Z:1.0\nS\t1\tACGTACGTTT\tLN:i:10\tDP:f:20.0\nS\t2\tTTGACCATTG\tLN:i:10\tRC:i:200\nS\t3\tGTCATTACCA\tLN:i:10\nL\t1\t+\t2\t+\t2M\nL\t2\t+\t3\t-\t2M\nL\t9\t-\t1\t+\t2M\n"


def write(path, text):
    path.write_text(text)
    return str(path)


def test_gfa(spark, tmp_path):
    s, l, _ = readers.read_gfa(spark, write(tmp_path / "a.gfa", GFA))
    assert {r["name"]: r["cov"] for r in s.collect()} == {"1": 20.0, "2": 20.0, "3": 1.0}
    assert {(r["v1"], r["e1"], r["v2"], r["e2"]) for r in l.collect()} == {("1", True, "2", False), ("2", False, "1", True), ("2", True, "3", True), ("3", True, "2", True)}
    writers.write_lines(writers.gfa_lines(s, l), str(tmp_path / "out"))
    again, links, _ = readers.read_gfa(spark, str(tmp_path / "out"))
    assert again.count() == 3 and links.exceptAll(l).count() == 0 and l.exceptAll(links).count() == 0


def test_gfa_errors(spark, tmp_path):
    with pytest.raises(Exception, match="contradicts"):
        readers.read_gfa(spark, write(tmp_path / "b.gfa", "S\t1\tACGT\tLN:i:5\n"))[0].collect()
    with pytest.raises(Exception, match="unsupported overlap"):
        readers.read_gfa(spark, write(tmp_path / "c.gfa", "S\t1\tACGT\nL\t1\t+\t1\t+\t5M1I\n"))[1].collect()


def test_fastg(spark, tmp_path):
    random.seed(2)
    a, mid, b = ("".join(random.choice("ACGT") for _ in range(n)) for n in (40, 21, 40))
    from_, to = a + mid, mid + b
    text = f">EDGE_1_length_61_cov_12.5:EDGE_2_length_61_cov_11.0;\n{from_}\n>EDGE_2_length_61_cov_11.0;\n{to}\n"
    s, l = readers.read_fastg(spark, write(tmp_path / "a.fastg", text))
    assert s.count() == 2 and {(r["v1"], r["e1"], r["v2"], r["e2"], r["overlap"]) for r in l.collect()} == {("1", True, "2", False, 21), ("2", False, "1", True, 21)}


def test_gaf(spark, tmp_path):
    text = "r1\t18\t0\t18\t+\t>1>2\t18\t0\t18\t18\t18\t60\tid:f:1.0\nr2\t20\t0\t9\t+\t<2<1\t18\t3\t12\t9\t10\t60\tcg:Z:9=\n"
    with gzip.open(tmp_path / "a.gaf.gz", "wt") as f:
        f.write(text)
    got = readers.read_alignments(spark, str(tmp_path / "a.gaf.gz")).orderBy("record_id").collect()
    assert [(r["query_name"], r["identity"], r["p_align_len"]) for r in got] == [("r1", 1.0, 18), ("r2", 0.9, 9)]
    assert got[1]["cigar"][0]["len"] == 9 and readers.read_gaf(spark, str(tmp_path / "a.gaf.gz"), 0.95).count() == 1
    with pytest.raises(ValueError):
        readers.alignment_format("x.sam")


def test_tsv_fasta_fastq_paths(spark, tmp_path):
    t = write(tmp_path / "a.tsv", "r\t1\t10\t0\t4\t12\t44+,24-\t9,4\tACGT\nr\t1,5\t9\t0\t4\t12\t44+\t9\tA\n")
    r = readers.read_spa_tsv(spark, t).collect()
    assert len(r) == 1 and r[0]["p_align_len"] == 13 and r[0]["identity"] is None
    assert [tuple(x) for x in readers.read_fasta(spark, write(tmp_path / "a.fa", ">x y\nAC\nGT\n>z\nA\n")).orderBy("label").collect()] == [("x y", "ACGT"), ("z", "A")]
    assert [tuple(x) for x in readers.read_fastq(spark, write(tmp_path / "a.fq", "@q1\nAC\n+\n##\n@q2\nG\n+\n#\n")).orderBy("query_name").collect()] == [("q1", "AC"), ("q2", "G")]
    assert readers.read_user_paths(spark, write(tmp_path / "p.txt", "53+,45-\n>1<2\n")).count() == 2
    with pytest.raises(Exception, match="not a path"):
        readers.read_user_paths(spark, write(tmp_path / "q.txt", "hello\n")).collect()


def test_simulated_proportions_come_back(spark, tmp_path):
    rng = random.Random(5)
    seq = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    names = {"a": 3000, "b": 2500, "c": 2500, "d": 3000}
    text = "".join(f"S\t{n}\t{seq(k)}\tDP:f:30\n" for n, k in names.items())
    text += "".join(f"L\t{x}\t+\t{y}\t+\t0M\n" for x, y in (("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")))
    g = write(tmp_path / "g.gfa", text)
    v = write(tmp_path / "v.txt", "a+,b+,d+\na+,c+,d+\n")
    reads = simulate(spark, g, v, [0.7, 0.3], "6000,1500", 4_000_000, gaf=str(tmp_path / "r.gaf"))
    assert reads.filter(F.col("p_start") < 0).count() == 0 and reads.filter(F.col("p_end") > F.col("p_len")).count() == 0
    r = thorough(spark, Options(graph=g, alignment=str(tmp_path / "r.gaf"), output=str(tmp_path / "out"), min_align_len=500, min_valid_search=40, bootstrap=4, topology="circular"))
    best = {P_: c for c, P_ in r.props.items()}
    paths = {x["cid"]: {s["n"] for s in x["path"]} for x in r.variants.collect()}
    got = {frozenset(paths[c]): p for c, p in r.props.items()}
    assert best and abs(got[frozenset("abd")] - 0.7) < 0.05 and abs(got[frozenset("acd")] - 0.3) < 0.05
    assert (tmp_path / "out" / "final.result.tab").is_dir() and (tmp_path / "out" / "pangenome.gfa").is_dir()
    tab = lambda name: spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "out" / name))
    final = tab("final.result.tab")
    assert final.columns[:4] == ["SOLUTIONS", "BOOTSTRAP_SUPPORT", "LOGLIKELIHOOD", "BIC"] and final.columns[-1] == "FREQ_STD_OF_BOOTSTRAP"
    assert all(x["LOGLIKELIHOOD"] != "*" for x in final.collect() if float(x["BOOTSTRAP_SUPPORT"]) > 0.05)
    held = tab("readpath.record_ids.tab").collect()
    assert {x["rp_id"] for x in held} == {x["rp_id"] for x in tab("readpath.information.tab").collect()} and len(held) > 1
    assert tab("sid.to.cid.tab").columns == ["sid", "cid"]
    assert len(list((tmp_path / "out" / "variants").glob("file=variant.*.fasta"))) == len(r.best) and (tmp_path / "out" / "options.yaml").is_file()
    with pytest.raises(FileExistsError):
        thorough(spark, Options(graph=g, alignment=str(tmp_path / "r.gaf"), output=str(tmp_path / "out")))


def test_partitioning_changes_nothing(spark):
    rng = random.Random(7)
    rows = [([(rng.choice("abcd"), rng.random() < 0.5) for _ in range(rng.randint(1, 5))],) for _ in range(400)]
    df = spark.createDataFrame(rows, "path array<struct<n:string,e:boolean>>")
    got = [sorted((tuple(map(tuple, r["path"])), r["n"], r["support"]) for r in R.supported(R.count_paths(df.repartition(k)), 3).collect()) for k in (1, 4, 16)]
    assert got[0] == got[1] == got[2]


def test_streaming_counts(spark, tmp_path):
    df = spark.createDataFrame([([("a", True), ("b", True)],), ([("b", False), ("a", False)],)], "path array<struct<n:string,e:boolean>>")
    df.write.parquet(str(tmp_path / "in"))
    stream = count_paths_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("paths").start()
    q.processAllAvailable()
    q.stop()
    assert [r["n"] for r in spark.sql("select n from paths").collect()] == [2]
