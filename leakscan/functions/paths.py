"""Path classifiers: pure column expressions over a path string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories, extensions and names whose content is not
# hand-written application code.
I18N_DIRECTORIES = (
    "i18n", "l10n", "intl", "translation", "translations", "locale", "locales", "lang", "langs",
)
DOC_DIRECTORIES = ("doc", "docs", "document", "documents", "documentation")
GENERATED_DIRECTORIES = (
    "dist", "build", "out", "output", "coverage", "vendor", "node_modules", "bower_components",
    "target", "obj", "__pycache__", ".next", ".nuxt", ".output", ".svelte-kit", ".angular",
    ".parcel-cache", ".turbo",
)
DOC_EXTENSIONS = ("md", "mdx", "markdown", "rst", "adoc", "asciidoc")
LOCKFILES = (
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock",
    "gemfile.lock", "go.sum", "cargo.lock", "poetry.lock", "podfile.lock", "flake.lock",
)
GENERATED_SUFFIXES = (".min.js", ".min.css", ".map")

# Extensions where an unquoted bare word is a variable.
CODE_EXTENSIONS = (
    "js", "jsx", "ts", "tsx", "mjs", "cjs", "py", "rb", "go", "java", "kt", "kts", "php", "cs",
    "cpp", "cc", "cxx", "c", "h", "hpp", "rs", "swift", "scala", "dart", "lua", "pl", "pm", "r",
    "mm", "vue", "svelte", "groovy", "clj", "ex", "exs",
)

# Env templates, and files that should never be committed.
ENV_TEMPLATE_SUFFIXES = ("example", "sample", "template", "dist", "defaults", "tpl", "test")
SECRET_FILE_NAMES = (
    "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", ".git-credentials", ".htpasswd", ".pgpass",
    ".netrc", "credentials",
)
SECRET_FILE_SUFFIXES = (".p12", ".pfx", ".pkcs12", ".keystore", ".jks", ".ppk", ".kdbx")

# Directories never searched for env files, next to the generated ones.
ENV_SKIP_DIRECTORIES = GENERATED_DIRECTORIES + (
    ".git", ".hg", ".svn", ".venv", "venv", "virtualenv", ".tox", ".gradle", ".terraform",
    ".cache", ".yarn", ".pnpm-store", "pods",
)


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _ends_with_any(name: Column, suffixes: tuple[str, ...]) -> Column:
    found = F.endswith(name, F.lit(suffixes[0]))
    for suffix in suffixes[1:]:
        found = found | F.endswith(name, F.lit(suffix))
    return found


def base_name(path: Column) -> Column:
    """Last path component, lower-cased; trailing slashes do not count."""
    return F.lower(F.substring_index(F.rtrim(path, F.lit("/")), "/", -1))


def _extension(name: Column) -> Column:
    """Text after the last dot, or '' when there is none or it leads the name."""
    return F.when(F.instr(F.substring(name, 2, 1 << 30), ".") > 0, F.substring_index(name, ".", -1)).otherwise("")


def heuristic_exempt(path: Column, default_excludes: bool = True) -> Column:
    """'i18n', 'docs' or 'generated' when the noisy layers do not apply, else null."""
    if not default_excludes:
        return F.lit(None).cast("string")
    normal = F.lower(F.translate(path, "\\", "/"))
    parts = F.filter(F.split(normal, "/", -1), lambda s: s != "")
    directories = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return (
        F.when(F.arrays_overlap(directories, _strings(I18N_DIRECTORIES)), "i18n")
        .when(F.arrays_overlap(directories, _strings(DOC_DIRECTORIES)), "docs")
        .when(F.arrays_overlap(directories, _strings(GENERATED_DIRECTORIES)), "generated")
        .when(_extension(name).isin(*DOC_EXTENSIONS), "docs")
        .when(name.isin(*LOCKFILES) | _ends_with_any(name, GENERATED_SUFFIXES), "generated")
    )


def is_code_file(path: Column) -> Column:
    return _extension(base_name(path)).isin(*CODE_EXTENSIONS)


def is_env_template(path: Column) -> Column:
    """A ``.env.*`` file whose last dot segment marks placeholders."""
    name = base_name(path)
    return F.startswith(name, F.lit(".env.")) & F.substring_index(name, ".", -1).isin(*ENV_TEMPLATE_SUFFIXES)


def is_dotenv_file(path: Column) -> Column:
    name = base_name(path)
    return (name == ".env") | (F.startswith(name, F.lit(".env.")) & ~is_env_template(path))


def filename_rule_ord(path: Column) -> Column:
    """Order number of the filename rule a path trips (see ``rules``), or null."""
    name = base_name(path)
    return (
        F.when(name == ".env", 1)
        .when(F.startswith(name, F.lit(".env.")) & ~is_env_template(path), 2)
        .when(name.isin(*SECRET_FILE_NAMES), 3)
        .when(_ends_with_any(name, SECRET_FILE_SUFFIXES), 4)
    )


def is_searched_for_env(path: Column) -> Column:
    """Whether an env file at this path is outside generated and vendored directories."""
    parts = F.filter(F.split(F.lower(path), "/", -1), lambda s: s != "")
    directories = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return ~F.arrays_overlap(directories, _strings(ENV_SKIP_DIRECTORIES))
