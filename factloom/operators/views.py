"""Views over the evidence tables: live and latest facts, typed reads, names, owners and noise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.names import address_or_text, canonical_address, canonical_predicate
from factloom.session import table

OWNER_PREDICATES = ("is_method_of", "is_constructor_of", "is_destructor_of")

# Names and owners that mark runtime code.
NOISE_PREFIXES = (
    "std::", "__gnu_cxx::", "__cxxabiv1::", "__gnu_", "__mingw_", "operator new", "operator delete", "operator.new", "operator.delete",
    "_Unwind_", "_ZN", "_M_", "_S_", "_Destroy", "_Construct", "__throw_", "_GLOBAL__sub_I_", ".weak.", "__copy_", "__niter_", "__miter_",
    "__relocate_", "__to_address", "__destroy", "__assign_one", "__new_allocator", "__normal_iterator", "_Vector_base", "forward<", "move<",
    "max<", "min<", "basic_string", "endl<", "allocator<", "SDL_", "TTF_",
)
NOISE_EXACT = (
    "_start", "frame_dummy", "register_tm_clones", "deregister_tm_clones", "__do_global_dtors_aux", "__libc_csu_init", "__libc_csu_fini", "_init",
    "_fini", "__gcc_register_frame", "__gcc_deregister_frame", "__main", "mark_section_writable", "_FindPESection", "atexit",
    "__mingw_GetSectionForAddress", "_Alloc_hider", "_GetPEImageBase", "_IsNonwritableInCurrentImage", "_ValidateImageBase", "vector",
    "__tmainCRTStartup", "mainCRTStartup", "main_getcmdline", "__getmainargs", "__p___argc", "__p___argv", "__p___wargv", "__p__acmdln",
    "__p__commode", "__p__environ", "__p__fmode", "__p__wenviron", "_configure_narrow_argv", "_configure_wide_argv", "_setargv",
    "__set_app_type", "_initialize_narrow_environment", "_initialize_wide_environment", "_initterm", "_cexit", "_crt_atexit",
    "_crt_at_quick_exit", "_onexit", "_exit", "exit", "abort", "_amsg_exit", "_set_new_mode", "_set_invalid_parameter_handler", "_matherr",
    "__setusermatherr", "fpreset", "__daylight", "__timezone", "__tzname", "tzset", "_tzset", "_time64", "_ismbblead", "__do_global_ctors",
    "__dyn_tls_init", "__dyn_tls_dtor", "__mingwthr_run_key_dtors", "_pei386_runtime_relocator", "do_pseudo_reloc",
    "restore_modified_sections", "check_managed_app", "duplicate_ppstrings", "__write_memory", "__report_error", "_get_output_format",
    "__acrt_iob_func", "__stdio_common_vfprintf", "__stdio_common_vfwprintf", "__static_initialization_and_destruction_0", "___chkstk_ms",
    "__C_specific_handler", "signal", "calloc", "malloc", "free", "memcpy", "memmove", "memset", "strlen", "strncmp", "rand", "srand",
    "fprintf", "fwrite", "vfprintf", "CommandLineToArgvW", "DeleteCriticalSection", "EnterCriticalSection", "FreeLibrary",
    "GetCommandLineW", "GetLastError", "GetModuleHandleA", "GetProcAddress", "GetProcessHeap", "GetStartupInfoA", "HeapAlloc", "HeapFree",
    "InitializeCriticalSection", "LeaveCriticalSection", "LoadLibraryA", "LocalFree", "SetUnhandledExceptionFilter", "Sleep", "TlsGetValue",
    "VirtualProtect", "VirtualQuery",
)
NOISE_CONTAINS = ("*>&)",)
NOISE_OWNERS = ("_Alloc_hider", "_Guard", "_Vector_impl", "_Vector_impl_data")
OWNERLESS = (
    "push_back", "size", "begin", "end", "cbegin", "clear", "erase", "c_str", "str", "length", "max_size", "deallocate", "allocate", "eq",
    "base", "operator!=", "operator*", "operator+", "operator++", "operator-", "operator<<", "operator[]",
)

#: Session setting: the folder of store_observations.
STORED = "spark.factloom.observations"
COLUMNS = ("id", "subject", "predicate", "value", "confidence", "source", "status", "created_at", "superseded_by")


def observations(spark: SparkSession, sf: str, once: bool = False) -> DataFrame:
    """All observations with canonical subjects and predicates.

    once: rows that were delivered twice come once.  That shuffles the whole table, so it is left to queries that
    count or list rows; maxima, sets and semi-joins don't need it, and their filters reach the scan.
    """
    if stored := spark.conf.get(STORED, None):
        rows = spark.read.parquet(stored).select(*COLUMNS)
        return rows.distinct() if once else rows
    rows = table(spark, sf, "observations").select(
        "id", address_or_text(F.col("subject")).alias("subject"), canonical_predicate(F.col("predicate")).alias("predicate"),
        "value", "confidence", "source", "status", "created_at", "superseded_by",
    )
    return rows.distinct() if once else rows


def store_observations(spark: SparkSession, sf: str, path: str) -> None:
    """Write the observations with canonical subjects and predicates, one folder per predicate, and read them from there from now on.

    The setting STORED of the session names the folder; queries then read the predicates they need only, and no query
    spells anything anew.  To be unset or renewed when observations are added.
    """
    observations(spark, sf).repartition("predicate", F.pmod(F.xxhash64("subject"), F.lit(16))).write.partitionBy("predicate").parquet(path)
    spark.conf.set(STORED, path)


def hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    """All hypotheses with canonical subjects, each id once."""
    return table(spark, sf, "hypotheses").withColumn("subject", address_or_text(F.col("subject"))).dropDuplicates(["id"])


def facts(obs: DataFrame, *predicates: str) -> DataFrame:
    return obs.where(F.col("predicate").isin(*predicates) & F.col("value").isNotNull())


def latest(rows: DataFrame, *by: str) -> DataFrame:
    """Per key the value of the row with the highest id."""
    return rows.where(F.col("value").isNotNull()).groupBy(*by).agg(F.max_by("value", "id").alias("value"), F.max("id").alias("id"))


def latest_of(obs: DataFrame, predicate: str, name: str) -> DataFrame:
    """(subject, name): the latest value of one predicate."""
    return latest(facts(obs, predicate), "subject").select("subject", F.col("value").alias(name))


def call_edges(obs: DataFrame) -> DataFrame:
    """(src, dst): the distinct call edges."""
    return facts(obs, "calls").select(F.col("subject").alias("src"), canonical_address(F.col("value")).alias("dst")).where("dst is not null").distinct()


def owners(obs: DataFrame) -> DataFrame:
    """(subject, owner): the latest owner, by precedence of the predicate that names it."""
    found = latest(facts(obs, *OWNER_PREDICATES), "subject", "predicate").groupBy("subject").pivot("predicate", list(OWNER_PREDICATES)).agg(F.first("value"))
    return found.select("subject", F.coalesce(*OWNER_PREDICATES).alias("owner"))


def is_reserved(c: Column) -> Column:
    """Names that the language keeps for its implementation."""
    return F.coalesce(c.rlike("__|^_[A-Z]"), F.lit(False))


def is_noise_name(c: Column) -> Column:
    bare = F.regexp_replace(c, "^~", "")
    either = [c.isin(*NOISE_EXACT), bare.isin(*NOISE_EXACT), *(x.startswith(p) for p in NOISE_PREFIXES for x in (c, bare)), *(c.contains(x) for x in NOISE_CONTAINS)]
    return reduce(lambda a, b: a | b, either)


def subject_classes(obs: DataFrame) -> DataFrame:
    """(subject, class): LIBRARY_OR_COMPILER for imports and for reserved owners or names, else APPLICATION."""
    subjects = obs.select("subject").where("subject is not null").distinct()
    imported = facts(obs, "imports").select("subject", F.lit(True).alias("imported")).distinct()
    owner = latest(facts(obs, *OWNER_PREDICATES), "subject").select("subject", F.col("value").alias("owner"))
    name = latest_of(obs, "has_name", "name")
    wide = subjects.join(imported, "subject", "left").join(owner, "subject", "left").join(name, "subject", "left")
    library = F.col("imported").isNotNull() | is_reserved(F.col("owner")) | is_reserved(F.col("name"))
    return wide.select("subject", "owner", "name", F.when(library, "LIBRARY_OR_COMPILER").otherwise("APPLICATION").alias("class"))


def noise(obs: DataFrame) -> DataFrame:
    """(subject, name, noise) of every named subject."""
    named = latest_of(obs, "has_name", "name").join(owners(obs), "subject", "left")
    by_owner = F.when(F.col("owner").isNotNull(), F.col("owner").isin(*NOISE_OWNERS)).otherwise(F.col("name").isin(*OWNERLESS))
    return named.select("subject", "name", (is_noise_name(F.col("name")) | by_owner).alias("noise"))


def dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """(source, target): a hypothesis depends on those modified by the investigation that created it."""
    inv = table(spark, sf, "investigations").dropDuplicates(["id"])
    pairs = inv.select(F.explode("hypotheses_created").alias("source"), "hypotheses_modified").select("source", F.explode("hypotheses_modified").alias("target"))
    made = hypotheses(spark, sf).where("created_by is not null").select(F.col("id").alias("source"), F.col("created_by").alias("inv"))
    more = made.join(inv.select(F.col("id").alias("inv"), F.explode("hypotheses_modified").alias("target")), "inv").select("source", "target")
    return pairs.unionByName(more).where("source <> target").distinct()


def numbered(rows: DataFrame, order: list[str], start: int) -> DataFrame:
    """rows with ``new_id``: start + 1, start + 2, ... in the given order, without gathering them in one task.

    The rows are range-partitioned and sorted; each partition's numbers begin after the counts of those before it.
    """
    from factloom.session import cut

    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    counts = sorted((r["_p"], r["count"]) for r in placed.groupBy("_p").count().collect())  # one row a partition
    offsets, total = [], start
    for p, n in counts:
        offsets.append((p, total))
        total += n
    spark = rows.sparkSession
    shift = F.broadcast(spark.createDataFrame(offsets or [(0, start)], "_p int, _shift bigint"))
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    return placed.withColumn("_n", at).join(shift, "_p").withColumn("new_id", F.col("_n") + F.col("_shift")).drop("_p", "_n", "_shift")
