"""File filtering, classification and package attribution over exploded path tables.

What a single machine would be asked for comes as tables: ``inventory`` (path), ``tracked``
(repo_root, path), ``package_files`` (path, package) and ``packages`` (manager, package, version).
A row of ``files`` has run_id, path and the run's repo_root, sys_prefix, sys_base_prefix, tool_dir.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.paths import after_site_packages, base_name, contains_any, starts_with_any, under

# Prefixes and patterns that decide which files count.
SYSTEM_READS = ["/sys/", "/etc/", "/sbin/", "/proc/", "/dev/", "/usr/", "/opt/", "/lib/", "/lib64/"]
COMPILE_CACHES = ["/tmp/torchinductor_", "/tmp/torch_", "/tmp/triton"]
WRITE_NOISE = ["/dev/", "/proc/", "/sys/", "/dev/shm/", "/usr/local/", "/usr/lib/", "/usr/share/", "/opt/"]
SIMPLE_WRITE_NOISE = [*WRITE_NOISE, "/etc/", "/lib/", "/lib64/", "/tmp/"]
SHARED_LIBRARY_DIRS = ["/usr/lib", "/lib", "/usr/lib64", "/lib64", "/usr/local/lib"]
SYSTEM_FILES = ["/usr/lib", "/usr/lib64", "/lib", "/lib64", "/usr/share", "/etc", "/usr/local/lib", "/opt"]
LIBRARY_READS = ["/lib/", "/lib64/", "/usr/lib/", "/usr/lib64/"]
CODE_EXTENSIONS = [".py", ".so", ".pyx", ".pxd", ".c", ".cpp", ".h", ".hpp", ".rs", ".go"]

CLASSES = ["repo", "package", "stdlib", "system", "unmanaged", "external", "skip"]
# Folder in which the provenance tool keeps its own files.
TOOL_FOLDER = ".provenance"


def is_code(path: Column) -> Column:
    hit = path.contains(".so.")
    for ext in CODE_EXTENSIONS:
        hit = hit | path.endswith(ext)
    return hit


def _own(path: Column, folder: str) -> Column:
    return path.contains(f"/{folder}/") | path.startswith(f"{folder}/")


def _set(folder: Column) -> Column:
    return F.coalesce(folder, F.lit("")) != ""


def is_package_file(path: Column, prefix: Column, base: Column) -> Column:
    """In site-packages, or below the environment's or the interpreter's prefix."""
    return (
        path.contains("site-packages")
        | (_set(prefix) & F.coalesce(path.startswith(prefix), F.lit(False)))
        | (_set(base) & F.coalesce(path.startswith(base), F.lit(False)))
    )


def keep_reads(
    files: DataFrame, system: bool = True, packages: bool = True, caches: bool = True, tmp: bool = True
) -> DataFrame:
    """Reads that matter; each switch says whether that kind is dropped."""
    path = F.col("path")
    drop = F.lit(False)
    if system:
        drop = drop | starts_with_any(path, SYSTEM_READS)
    if caches:
        drop = drop | starts_with_any(path, COMPILE_CACHES)
    if packages:
        drop = drop | is_package_file(path, F.col("sys_prefix"), F.col("sys_base_prefix"))
    if tmp:
        drop = drop | path.startswith("/tmp/")
    return files.where(~drop)


def keep_writes(files: DataFrame, caches: bool = True, tmp: bool = True, tool_folder: str = TOOL_FOLDER) -> DataFrame:
    path = F.col("path")
    drop = starts_with_any(path, [*WRITE_NOISE, "/etc/"]) | _own(path, tool_folder) | path.endswith(".pyc")
    if caches:
        drop = drop | starts_with_any(path, COMPILE_CACHES)
    if tmp:
        drop = drop | path.startswith("/tmp/")
    return files.where(~drop)


def unread_tmp_files(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Temporary files written but not read by the run (strict mode lists them)."""
    key = ["run_id", "path"]
    kept = keep_writes(writes, tmp=False).where(F.col("path").startswith("/tmp/"))
    return kept.select(*key).distinct().join(reads.select(*key), key, "left_anti")


def is_noise_read(path: Column) -> Column:
    return (
        starts_with_any(path, [*SYSTEM_READS, *COMPILE_CACHES]) | path.contains("site-packages") | path.endswith(".pyc")
    )


def is_noise_write(path: Column, tool_folder: str = TOOL_FOLDER) -> Column:
    return starts_with_any(path, SIMPLE_WRITE_NOISE) | _own(path, tool_folder) | path.endswith(".pyc")


def classify(files: DataFrame, inventory: DataFrame, tracked: DataFrame, package_files: DataFrame) -> DataFrame:
    """Adds ``class`` and ``package`` to every file."""
    path = F.col("path")
    exists = inventory.select("path").distinct().withColumn("_exists", F.lit(True))
    in_git = tracked.select("repo_root", "path").distinct().withColumn("_tracked", F.lit(True))
    owned = package_files.groupBy("path").agg(F.min("package").alias("_owner"))
    rows = files.join(exists, "path", "left").join(in_git, ["repo_root", "path"], "left").join(owned, "path", "left")
    library = path.contains(".so") & starts_with_any(path, SHARED_LIBRARY_DIRS)
    system = starts_with_any(path, SYSTEM_FILES) | (path.contains(".so") & contains_any(path, ["/lib", "/usr"]))
    in_repo = under(path, F.col("repo_root")) & ~contains_any(path, [".venv", "site-packages"])
    kind = (
        F.when(F.col("_exists").isNull(), "skip")
        .when(_set(F.col("tool_dir")) & path.startswith(F.col("tool_dir")), "skip")
        .when(starts_with_any(path, ["/dev/", "/proc/"]), "external")
        .when(in_repo & F.col("_tracked").isNotNull(), "repo")
        .when(in_repo, "unmanaged")
        .when(F.col("_owner").isNotNull() | path.contains("site-packages"), "package")
        .when(library, "system")
        .when(under(path, F.col("sys_base_prefix")), "stdlib")
        .when(under(path, F.col("sys_prefix")), "package")
        .when(system, "system")
        .otherwise("unmanaged")
    )
    return rows.withColumn("class", kind).withColumn(
        "package", F.when(F.col("class") == "package", F.coalesce("_owner", F.lit("unknown")))
    ).select(*files.columns, "class", "package")


def class_counts(classified: DataFrame) -> DataFrame:
    """Files per class and run, one column per class."""
    return classified.groupBy("run_id").agg(*[F.count_if(F.col("class") == c).alias(c) for c in CLASSES])


def classified_packages(classified: DataFrame, versions: DataFrame) -> DataFrame:
    """(run_id, package, version) of the named packages a run touched; ``versions``: (package, version)."""
    named = classified.where(F.coalesce(F.col("package"), F.lit("unknown")) != "unknown").select("run_id", "package").distinct()
    known = versions.groupBy("package").agg(F.max("version").alias("version"))
    return named.join(known, "package", "left").select("run_id", "package", F.coalesce("version", F.lit("unknown")).alias("version"))


def version_control_class(files: DataFrame, tracked: DataFrame) -> DataFrame:
    in_git = tracked.select("repo_root", "path").distinct().withColumn("_tracked", F.lit(True))
    path = F.col("path")
    kind = (
        F.when(under(path, F.col("repo_root")), F.when(F.col("_tracked"), "tracked").otherwise("untracked"))
        .when(path.contains("site-packages"), "site-package")
        .otherwise("external")
    )
    return files.join(in_git, ["repo_root", "path"], "left").select(*files.columns, kind.alias("class"))


def all_files(*parts: DataFrame) -> DataFrame:
    """Distinct (run_id, path) of opened, read and module files."""
    out = parts[0].select("run_id", "path")
    for part in parts[1:]:
        out = out.unionByName(part.select("run_id", "path"))
    return out.distinct()


def data_inputs(reads: DataFrame, classified: DataFrame, tool_marker: str = "/provenance/inject") -> DataFrame:
    """Reads without noise and without the repository's own code."""
    path = F.col("path")
    noise = (
        path.endswith(".pyc") | path.contains(".triton") | path.contains(tool_marker) | starts_with_any(path, LIBRARY_READS)
    )
    code = classified.where((F.col("class") == "repo") & is_code(path)).select("run_id", "path")
    return reads.where(~noise).select("run_id", "path").distinct().join(code, ["run_id", "path"], "left_anti")


def unmanaged_code(classified: DataFrame, tool_folder: str = TOOL_FOLDER) -> DataFrame:
    """Unmanaged files that are code and not a cache or the tool's own."""
    noise = contains_any(F.col("path"), [tool_folder, ".triton", "torchinductor"]) | F.col("path").endswith(".pyc")
    return classified.where((F.col("class") == "unmanaged") & ~noise & is_code(F.col("path"))).select("run_id", "path")


def library_package(path: Column) -> Column:
    """Package name in a site-packages path: nvidia parts by their folder, ``x.libs`` as x."""
    rest = after_site_packages(path)
    top = F.split_part(rest, F.lit("/"), F.lit(1))
    part = F.split_part(rest, F.lit("/"), F.lit(2))
    return F.when((top == "nvidia") & rest.contains("/"), F.concat(F.lit("nvidia-"), part)).otherwise(
        F.regexp_replace(top, r"\.libs$", "")
    )


def _package_key(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("-"), F.lit("_"))


def attribute_libraries(libraries: DataFrame, installed: DataFrame, owners: DataFrame) -> DataFrame:
    """(run_id, path, manager, package, managed) of loaded shared libraries.

    ``libraries``: (run_id, path, sys_prefix); ``installed``: (run_id, name); ``owners``: (path, package)
    of the system's package manager.
    """
    path = F.col("path")
    rows = libraries.where(~starts_with_any(path, ["/proc/", "/dev/"]))
    in_site = path.contains("site-packages")
    names = installed.groupBy("run_id", _package_key(F.col("name")).alias("_key")).agg(F.min("name").alias("_installed"))
    owned = owners.groupBy("path").agg(F.min("package").alias("_owner"))
    rows = (
        rows.withColumn("_name", F.when(in_site, library_package(path)))
        .withColumn("_key", _package_key(F.col("_name")))
        .join(names, ["run_id", "_key"], "left")
        .join(owned, "path", "left")
    )
    in_prefix = under(path, F.col("sys_prefix"))
    return rows.select(
        "run_id", "path",
        F.when(in_site | in_prefix, "pip").when(F.col("_owner").isNotNull(), "dpkg").alias("manager"),
        F.when(in_site, F.coalesce("_installed", F.nullif(F.col("_name"), F.lit("")))).when(~in_prefix, F.col("_owner")).alias("package"),
        (in_site | in_prefix | F.col("_owner").isNotNull()).alias("managed"),
    )


def system_packages(attributed: DataFrame, versions: DataFrame) -> DataFrame:
    """(run_id, package, version) of the system packages whose libraries a run loaded."""
    used = attributed.where((F.col("manager") == "dpkg") & F.col("package").isNotNull()).select("run_id", "package").distinct()
    known = versions.groupBy("package").agg(F.max("version").alias("version"))
    return used.join(known, "package", "left").select("run_id", "package", "version")


def run_packages(used: DataFrame, classified: DataFrame, system: DataFrame) -> DataFrame:
    """(run_id, manager, package, version): pip from used packages, else from classified files; dpkg."""
    reported = used.select("run_id").distinct()
    fallback = classified.join(reported, "run_id", "left_anti")

    def tagged(df: DataFrame, manager: str) -> DataFrame:
        return df.select("run_id", F.lit(manager).alias("manager"), "package", "version")

    return tagged(used, "pip").unionByName(tagged(fallback, "pip")).unionByName(tagged(system, "dpkg"))


def used_packages(modules: DataFrame, package_dirs: DataFrame, installed: DataFrame) -> DataFrame:
    """(run_id, package, version) behind loaded modules; an unknown top folder has no version.

    ``modules``: (run_id, path); ``package_dirs``: (top_dir, package); ``installed``: (run_id,
    package, version).
    """
    top = F.regexp_replace(F.split_part(after_site_packages(F.col("path")), F.lit("/"), F.lit(1)), r"\.py$", "")
    tops = modules.select("run_id", top.alias("top_dir")).where(F.col("top_dir").isNotNull()).distinct()
    owners = package_dirs.groupBy("top_dir").agg(F.max("package").alias("owner"))
    rows = tops.join(owners, "top_dir", "left")
    known = rows.where(F.col("owner").isNotNull()).select("run_id", F.col("owner").alias("package")).distinct().join(
        installed, ["run_id", "package"]
    )
    unknown = rows.where(
        F.col("owner").isNull() & ~F.col("top_dir").startswith("_") & ~F.col("top_dir").endswith(".so")
    ).select("run_id", F.col("top_dir").alias("package"), F.lit(None).cast("string").alias("version"))
    fresh = unknown.join(known.select("run_id", "package"), ["run_id", "package"], "left_anti")
    return known.select("run_id", "package", "version").unionByName(fresh)


# Program names that count as build tools.
BUILD_TOOLS = [
    "cmake", "gcc", "g++", "cc", "c++", "make", "gmake", "ninja", "meson", "rustc", "cargo", "nvcc", "ar", "ld", "as",
    "ranlib", "strip", "pkg-config", "autoconf", "automake", "libtool", "nasm",
]
PYTHON_BUILD_TOOLS = ["uv", "pip", "pip3", "setuptools", "maturin", "hatch", "flit", "poetry", "pdm", "pipx"]


def _tools(processes: DataFrame, known: list[str], locations: DataFrame) -> DataFrame:
    """(run_id, tool, location, inside): tools a run started and where they are installed."""
    started = processes.where(F.size("command") > 0).select(
        "run_id", "sys_prefix", base_name(F.col("command")[0]).alias("tool")
    ).where(F.col("tool").isin(known)).distinct()
    inside = (_set(F.col("sys_prefix")) & F.col("location").startswith(F.col("sys_prefix"))) | F.col("location").contains("site-packages")
    return started.join(locations.select("tool", "location"), "tool").withColumn("inside", F.coalesce(inside, F.lit(False)))


def build_tools(processes: DataFrame, locations: DataFrame, owners: DataFrame, versions: DataFrame) -> DataFrame:
    """System build tools of every run with owner package and version.

    ``processes``: (run_id, command, sys_prefix); ``locations``: (tool, location).
    """
    found = _tools(processes, BUILD_TOOLS, locations).where(~F.col("inside"))
    packages = found.join(owners.select(F.col("path").alias("location"), "package"), "location").select("run_id", "package").distinct()
    known = versions.groupBy("package").agg(F.max("version").alias("version"))
    return packages.join(known, "package").select("run_id", "package", "version")


def python_build_tools(processes: DataFrame, locations: DataFrame, versions: DataFrame) -> DataFrame:
    """Build tools installed in the environment itself; pip3 counts as pip."""
    found = _tools(processes, PYTHON_BUILD_TOOLS, locations).where("inside")
    package = F.when(F.col("tool") == "pip3", "pip").otherwise(F.col("tool"))
    known = versions.groupBy("package").agg(F.max("version").alias("version"))
    return found.select("run_id", package.alias("package")).distinct().join(known, "package").select("run_id", "package", "version")
