"""File featurisation and path filters: narrow jobs, one pass over the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.functions import features as fx
from codesift.session import shuffled

# ---------------------------------------------------------------------------
# Paths that are not audited.
SKIP_DIRS = (r"node_modules|vendor|bower_components|jspm_packages|libs?|dist|build|out|target|bin|obj|output|coverage|"
             r"reports?|logs|tmp|temp|\.cache|cache|artifacts|abi|deployment|data|\.data|\.git|\.svn|\.hg|\.github|"
             r"\.gitlab|\.circleci|\.travis|\.idea|\.vscode|\.vs|\.history|spec|__tests__|__mocks__|__fixtures__|tools|"
             r"examples?|demo|stories")
SKIP_DIRS_ANY_CASE = r"tests?|mocks?|scripts?"
SKIP_NAMES = (r"package-lock\.json|yarn\.lock|pnpm-lock\.yaml|Cargo\.lock|Gemfile\.lock|poetry\.lock|composer\.lock|"
              r"\.DS_Store|\.gitmodules|\.gitignore|\.gitattributes|\.gitkeep|\.t\.sol|\.s\.sol|\.d\.ts|Makefile|"
              r"Cargo\.toml|go\.mod|go\.sum|package\.json|tsconfig\.json|foundry\.toml|forge\.toml|remappings\.txt|"
              r"\.env\.example|Dockerfile|\.dockerignore")
SKIP_SUFFIXES_ANY_CASE = (
    r"\.(?:npm|yarn|pnpm)-?(?:lock|shrinkwrap)?\.(?:json|yaml)|\.(?:min\.js|min\.css|map)|\.(?:pyc|pyo)|"
    r"\.(?:class|jar|war|ear)|\.(?:exe|dll|so|dylib|o|obj|a|lib)|\.(?:wasm|wast)|"
    r"\.(?:log|pid|lock|bak|swp|swo|tmp|temp)|\.(?:tsbuildinfo|jsbuildinfo)|\.(?:env|env\..+)|"
    r"\.(?:yaml|yml|toml|json|xml|html|css|scss|less)|\.(?:md|markdown|txt|rst|adoc)|"
    r"\.(?:png|jpg|jpeg|gif|svg|ico|webp|bmp|tiff)|\.(?:ttf|woff2?|eot|otf)|\.(?:pdf|docx?|xlsx?|pptx?)|"
    r"\.(?:zip|tar|gz|bz2|7z|rar)|\.(?:test|spec|mock|stories)\.(?:js|ts|jsx|tsx|sol|py|go|rs)|\.cy\.(?:js|ts)|"
    r"\.e2e\.(?:js|ts)|hardhat\.config\.(?:js|ts)|\.eslintrc\.[a-z]+|\.prettierrc\.[a-z]+")
# ---------------------------------------------------------------------------

SKIP_PATTERNS = [rf"(?:^|/)(?:{SKIP_DIRS})/|__pycache__/|(?:{SKIP_NAMES})$",
                 rf"(?i)(?:^|/)(?:{SKIP_DIRS_ANY_CASE})/|(?:{SKIP_SUFFIXES_ANY_CASE})$"]


def normal_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def skips(path: Column) -> Column:
    """The path itself looks like something that is not audited."""
    p = normal_path(path)
    return p.rlike(SKIP_PATTERNS[0]) | p.rlike(SKIP_PATTERNS[1])


def skips_in_tree(path: Column) -> Column:
    """As :func:`skips`, and a folder whose own name looks like a skipped file
    takes everything below it along."""
    p = normal_path(path)
    folder_as_file = [rf"(?:{SKIP_NAMES})(?:/|$)", rf"(?i)(?:{SKIP_SUFFIXES_ANY_CASE})(?:/|$)"]
    return skips(path) | p.rlike(folder_as_file[0]) | p.rlike(folder_as_file[1])


def path_skip_filter(files: DataFrame) -> DataFrame:
    return files.filter(~skips_in_tree(F.col("path")))


def binary_filter(files: DataFrame) -> DataFrame:
    return files.filter(~fx.is_binary(F.col("content")))


def featurize_files(files: DataFrame) -> DataFrame:
    """files(project_id, path, content) plus language, size, score and imports."""
    content = F.col("content")
    return files.select(
        "project_id", normal_path(F.col("path")).alias("path"), "content", fx.detect_language(F.col("path")).alias("language"),
        F.length(content).alias("size"), fx.attack_score(content).alias("attack_score"),
        fx.extract_imports(content).alias("imports"))


def file_context(files: DataFrame) -> DataFrame:
    """Per-file facts the rules look at."""
    from codesift.rules.solidity import file_facts

    facts = file_facts()
    return files.select(
        "project_id", "path", facts["f_safe_erc20"].alias("has_safe_erc20"), facts["f_guard"].alias("has_reentrancy_guard"),
        facts["f_chain_id"].alias("has_chain_id"), facts["f_safe_math"].alias("has_safe_math"),
        facts["f_minor"].alias("pragma_minor"))


def explode_imports(files: DataFrame) -> DataFrame:
    return files.select("project_id", "path", F.explode("imports").alias("import"))


def sort_attack_score(files: DataFrame) -> DataFrame:
    return files.orderBy(F.col("attack_score").desc(), "project_id", "path")


def unseen_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    return files.join(shuffled(seen.select("project_id", "path")), ["project_id", "path"], "left_anti")


def score_filter(files: DataFrame, seen: DataFrame, above: float = 0.1) -> DataFrame:
    return unseen_files(files.filter(F.col("attack_score") > above), seen)


def function_signatures(files: DataFrame, k: int = 10) -> DataFrame:
    """First ``k`` function heads of each project's file with the highest score."""
    best = files.groupBy("project_id").agg(F.max_by("path", F.struct("attack_score", F.col("path"))).alias("path"))
    heads = F.slice(F.regexp_extract_all("content", F.lit(r"function \w+\([^)]*\)[^{]*"), F.lit(0)), 1, k)
    return (files.select("project_id", "path", F.array_join(heads, "\n").alias("signatures"))
            .join(best, ["project_id", "path"], "left_semi"))
