"""Types of the tables that the operators exchange."""

from pyspark.sql import types as T

STEP = T.StructType([T.StructField("n", T.StringType()), T.StructField("e", T.BooleanType())])
PATH = T.ArrayType(STEP)

SEGMENTS = "name string, len int, cov double, seq string, attrs map<string,string>"
HALF_EDGES = "v1 string, e1 boolean, v2 string, e2 boolean, overlap int"
ALIGNMENTS = (
    "record_id long, query_name string, query_len int, q_start int, q_end int, q_strand boolean, path_str string, "
    "path array<struct<n:string,e:boolean>>, p_len int, p_start int, p_end int, p_align_len int, num_match int, align_len int, "
    "mapq int, tags map<string,string>, cigar array<struct<len:int,op:string>>, identity double"
)
VARIANTS = "cid int, path array<struct<n:string,e:boolean>>, size long, circular boolean, source string"
