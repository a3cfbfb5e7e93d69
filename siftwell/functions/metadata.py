"""Derived columns of entries: category, language, ranks, eligibility and the location prior."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bytesql import LOWER, bytes_view, fold, sub

# Extensions by category.
CATEGORIES = {
    "video": "mp4 m4v mov mkv avi webm wmv flv mpg mpeg 3gp mts m2ts vob ogv hevc",
    "audio": "mp3 wav flac aac m4a ogg opus aif aiff alac wma mid midi caf",
    "image": "jpg jpeg png gif heic heif webp tif tiff bmp svg ico icns raw cr2 cr3 nef arw dng psd avif",
    "doc": "pdf doc docx txt md rtf pages odt xls xlsx csv ppt pptx key numbers epub tex",
    "archive": "zip tar gz tgz bz2 xz 7z rar dmg iso zst pkg xip",
    "code": "c cc cpp cxx h hh hpp rs go py js mjs ts tsx jsx java kt swift m mm rb php sh fish zsh lua cs zig json toml yaml yml html css scss sql",
    "font": "ttf otf woff woff2 ttc dfont",
}
# Languages whose symbols are read, by extension.
LANGUAGES = {
    "c": "c", "cpp": "h cc cpp cxx c++ hh hpp hxx", "objc": "m mm", "rust": "rs", "go": "go", "python": "py pyi", "js": "js mjs cjs jsx", "ts": "ts tsx mts cts",
    "swift": "swift", "java": "java", "kotlin": "kt kts", "csharp": "cs", "ruby": "rb", "php": "php", "lua": "lua", "zig": "zig", "shell": "sh bash zsh fish",
}
# Extensions that are never text.
BINARY = (
    "png jpg jpeg gif heic heif webp tif tiff bmp ico icns psd avif jxl raw cr2 cr3 nef arw dng mp4 mov m4v mkv avi webm wmv flv mpg mpeg "
    "mp3 m4a aac wav flac aiff aif ogg opus caf mid midi zip tar gz tgz bz2 xz 7z rar dmg iso zst lz4 xip pkg jar war whl egg apk ipa "
    "ttf otf woff woff2 ttc eot o a so dylib dll exe obj lib class pyc pyo wasm node bin dat db sqlite sqlite3 db-wal db-shm pdf doc docx xls "
    "xlsx ppt pptx pages numbers key odt ods epub pak car nib mlmodel onnx pt pth ckpt safetensors gguf npy npz parquet arrow feather h5 hdf5 "
    "tfrecord pb idx pack keystore p12 der cer mobileprovision dex res icc ktx dds exr hdr blend fbx glb usdz unitypackage ai sketch fig xcf"
)
# Folders whose content isn't searched.
SKIP_NAMES = (
    "node_modules .git target DerivedData __pycache__ .venv venv site-packages Pods .next .turbo .cache .build .rustup .cargo .npm .bun .nvm .pnpm-store "
    "coverage .Trash .svn .hg .gradle .m2 .pyenv .rbenv .gem .conda miniconda3 anaconda3 .docker .orbstack .colima .lima .ollama .android .expo .terraform.d "
    ".wrangler .vscode-server cache Cache caches Caches"
)
SKIP_BELOW_HOME = ("Library", "go/pkg", ".cursor/extensions", ".vscode/extensions", ".local/share", ".local/state", ".config/gcloud", ".codex/.tmp")
SKIP_SUFFIXES = ".app .photoslibrary .library .lrlibrary .musiclibrary .tvlibrary .imovielibrary .xcassets .framework .bundle .xcarchive .xcresult .dSYM .salon .lrdata"
# What a folder's name adds to the rank of all below it; the first rule that applies.
PRIOR_TOP = {"Users": 0, "Applications": 10, "Volumes": -10, "Library": -25, "opt": -25, "System": -40}
PRIOR_TOP_OTHER = -35
PRIOR_BUNDLES = "framework bundle plugin appex kext xpc lproj xcassets photoslibrary musiclibrary tvlibrary imovielibrary dsym xcarchive sdk platform"
PRIOR_NAMES = (
    (-20, "Library|Caches|caches|cache|Cache|Logs|DerivedData|CoreSimulator"),
    (-30, "node_modules|__pycache__|site-packages|Pods|venv|bower_components"),
    (-12, "target|build|dist|out|vendor|deps|tmp|temp"),
    (-10, "folders|Containers|Group Containers"),
    (-5, "Application Support"),
)
PRIOR_LOW, PRIOR_HIGH, PRIOR_HOME = -100, 60, 15
LOW_RANK = (".jsonl", ".ndjson", ".log", ".lock", ".sum")
CONTENT_BYTES, MINIFIED_PROBE, MINIFIED_LEAST, MINIFIED_LINE = 1 << 20, 1 << 16, 4096, 300
HEX_NAME = "^[0-9a-f]{16,255}$"


def last_dot(name: Column) -> Column:
    """0-based place of the last dot, or -1."""
    return F.when(F.instr(name, ".") > 0, F.length(name) - F.instr(F.reverse(name), ".")).otherwise(-1)


def extension(name: Column) -> Column:
    """Folded text after the last dot; null without a dot."""
    return F.when(F.instr(name, ".") > 0, fold(F.substring_index(name, ".", -1)))


def _lookup(name: Column, table: dict[str, str], longest: int) -> Column:
    ext = extension(name)
    kinds = F.create_map(*(F.lit(x) for kind, words in table.items() for word in words.split() for x in (word, kind)))
    return F.when((last_dot(name) > 0) & (F.octet_length(ext) <= longest), F.try_element_at(kinds, ext))


def category(name: Column) -> Column:
    return _lookup(name, CATEGORIES, 8)


def language(name: Column) -> Column:
    return _lookup(name, LANGUAGES, 5)


def size_class(size: Column) -> Column:
    """0 below 256 bytes, then one more for every factor of four, 15 at most."""
    return F.when(size < 256, 0).otherwise(F.least(F.lit(15), F.floor((F.length(F.bin(size)) - 9) / 2) + 1)).cast("int")


def is_hex_name(name: Column) -> Column:
    return name.rlike(HEX_NAME)


def packed_hex(name: Column) -> Column:
    """A hex name in half its bytes, after one for its length."""
    return F.concat(F.unhex(F.lpad(F.hex(F.length(name)), 2, "0")), F.unhex(F.when(F.length(name) % 2 == 1, F.concat(name, F.lit("0"))).otherwise(name)))


def unpacked_hex(packed: Column) -> Column:
    """The name that packed_hex packed."""
    digits = F.lower(F.hex(packed))
    return F.substring(digits, F.lit(3), F.conv(F.substring(digits, 1, 2), 16, 10).cast("int"))


# The bits of character classes, in this order; letters and digits have one each.
CLASSES = (*LOWER, *"0123456789", ".", "-_", " ", "\x80-\xff", "other")
STARTS = 23


def char_mask(name: Column) -> Column:
    """The classes of characters (CLASSES) in a name, as bits. A name can hold a word only if it has all the word's bits."""
    text, out = fold(bytes_view(name)), F.lit(0).cast("long")
    for i, c in enumerate(CLASSES):
        if i < 36:
            held = F.contains(text, F.lit(c))
        else:
            held = text.rlike("[^a-z0-9._ \x80-\xff-]" if c == "other" else f"[{c}]")
        out = out.bitwiseOR(F.when(held, F.lit(1 << i)).otherwise(0).cast("long"))
    return out


def start_mask(name: Column) -> Column:
    """The bytes with which words of a name begin (after a dot at its start, and after spaces), dealt over STARTS bits."""
    text = fold(bytes_view(name))
    first = F.when(F.length(text) > 1, F.regexp_replace(text, r"^\.", "")).otherwise(text)
    begins = F.concat(F.filter(F.array(F.substring(first, 1, 1)), lambda c: c != ""), F.regexp_extract_all(text, F.lit(r"(?s)(?<= )."), F.lit(0)))
    return F.aggregate(begins, F.lit(0), lambda m, c: m.bitwiseOR(F.call_function("shiftleft", F.lit(1), F.ascii(c) % STARTS)))


def doc_rank(path: Column) -> Column:
    """Order tier of searched content: dot folders and logs come late."""
    name = F.substring_index(path, "/", -1)
    low = F.lit(False)
    for x in LOW_RANK:
        low = low | name.endswith(x)
    return (F.when(F.contains(path, F.lit("/.")), -2).otherwise(0) + F.when(low, -1).otherwise(0)).cast("int")


def text_file(name: Column, size: Column) -> Column:
    """Whether a file is worth opening to see if it is text."""
    ext = extension(name)
    named = name.endswith(".min.js") | (name == "package-lock.json") | (name == ".DS_Store")
    known = (last_dot(name) > 0) & (F.octet_length(ext) <= 16) & ext.isin(BINARY.split())
    return (size > 0) & (size <= CONTENT_BYTES) & ~named & ~F.coalesce(known, F.lit(False))


def skipped_folder(below_home: Column, name: Column) -> Column:
    out = name.isin(SKIP_NAMES.split()) | below_home.isin(*SKIP_BELOW_HOME)
    for x in SKIP_SUFFIXES.split():
        out = out | (name.endswith(x) & (F.octet_length(name) > len(x)))
    return out


def in_content_area(path: Column, home: str) -> Column:
    """Whether a path is inside home with no skipped folder on the way."""
    rel = sub(path, len(home) + 2)
    parts = F.split(rel, "/")
    folders = F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.size(parts) > 1)
    skipped = F.exists(folders, lambda i: skipped_folder(F.array_join(F.slice(parts, 1, i), "/"), F.element_at(parts, i)))
    return (path == home) | (path.startswith(home.rstrip("/") + "/") & ~skipped)


def looks_binary(content: Column) -> Column:
    """A zero byte among the first 8,192 of a binary column."""
    return F.instr(F.decode(F.substring(content, 1, 8192), "ISO-8859-1"), "\x00") > 0


def minified(text: Column) -> Column:
    """More than 300 bytes a line in the first 64 KiB, of 4 KiB or more."""
    head = sub(bytes_view(text), 1, MINIFIED_PROBE)
    lines = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
    return (F.length(head) >= MINIFIED_LEAST) & (F.floor(F.length(head) / lines) > MINIFIED_LINE)


def prior_step(name: Column, depth: Column, whole_disk: bool) -> Column:
    out = F.when(F.lit(False), 0)
    if whole_disk:
        top = F.lit(PRIOR_TOP_OTHER)
        for k, v in PRIOR_TOP.items():
            top = F.when(name == k, v).otherwise(top)
        out = out.when(depth == 1, top)
    bundle = F.lit(False)
    for x in PRIOR_BUNDLES.split():
        bundle = bundle | (fold(name).endswith(f".{x}") & (F.octet_length(name) > len(x) + 1))
    out = out.when(name == "Applications", 30).when(name.endswith(".app"), -25).when(bundle, -20).when(name.startswith("."), -25)
    for value, names in PRIOR_NAMES:
        out = out.when(name.isin(names.split("|")), value)
    return out.otherwise(0)


def prior(folders: Column, whole_disk: bool = False, home: list[str] | None = None) -> Column:
    """Rank of everything below a chain of folder names under the root; home: that chain's names for the home folder."""

    def step(acc: Column, name: Column) -> Column:
        depth = acc["depth"] + 1
        add = prior_step(name, depth, whole_disk)
        if home:
            add = add + F.when((depth == len(home)) & (F.slice(folders, 1, len(home)) == F.array(*map(F.lit, home))), PRIOR_HOME).otherwise(0)
        return F.struct(F.greatest(F.lit(PRIOR_LOW), F.least(F.lit(PRIOR_HIGH), acc["value"] + add)).cast("int").alias("value"), depth.cast("int").alias("depth"))

    return F.aggregate(folders, F.struct(F.lit(0).alias("value"), F.lit(0).alias("depth")), step, lambda acc: acc["value"])


def rank_tweaks(name: Column, hidden: Column, dir_or_link: Column, mtime: Column, now: int) -> Column:
    age = F.greatest(F.lit(now) - mtime, F.lit(0))
    fresh = F.when(age <= 86_400, 10).when(age <= 604_800, 7).when(age <= 2_592_000, 4).when(age <= 31_536_000, 1).otherwise(0)
    return F.when(name.startswith("."), -8).otherwise(0) + F.when(hidden, -8).otherwise(0) + F.when(dir_or_link & name.endswith(".app"), 25).otherwise(0) + fresh


def trim_line(line: Column) -> Column:
    """A line without the carriage returns, blanks and tabs at its end, cut at 200 bytes between characters."""
    bare = F.regexp_replace(line, r"[\r \t]+\z", "")
    head = sub(bytes_view(bare), 1, 200)
    # drop a sequence that the cut has left incomplete
    whole = F.regexp_replace(head, "(?s)(?:[Â-ß]|[à-ï][\u0080-¿]?|[ð-ô][\u0080-¿]{0,2})\\z", "")
    return F.when(F.octet_length(bare) <= 200, bare).otherwise(F.decode(F.encode(whole, "ISO-8859-1"), "UTF-8"))
