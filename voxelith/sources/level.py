"""Level-wide files of a save: from a captured template or from defaults, with spawn, name and time filled in."""

from __future__ import annotations

import gzip
import io
import zipfile

from voxelith.sources.binary import Tag, decode_nbt, encode_nbt
from voxelith.sources.chunks import DATA_VERSION
from voxelith.sources.files import resolve

# Names of a save's files and fields, what an export must say of itself, and type numbers of the tree format.
LEVEL, LEVEL_OLD, RULES = "level.dat", "level.dat_old", "data/minecraft/game_rules.dat"
REGIONS = "dimensions/minecraft/overworld/region"
DIFFICULTY, GAME_TYPE, COMMANDS = "peaceful", 1, 1
OFF = ("minecraft:advance_time", "minecraft:advance_weather", "minecraft:spawn_mobs")
BYTE, INT, LONG, STRING, LIST, COMPOUND, INTS = 1, 3, 4, 8, 9, 10, 11


def default_template() -> dict[str, bytes]:
    """The level-wide files that an export needs, without a captured save."""
    data = {
        "DataVersion": Tag(INT, DATA_VERSION), "GameType": Tag(INT, GAME_TYPE), "allowCommands": Tag(BYTE, COMMANDS), "LevelName": Tag(STRING, ""), "LastPlayed": Tag(LONG, 0),
        "difficulty_settings": Tag(COMPOUND, {"difficulty": Tag(STRING, DIFFICULTY)}), "ServerBrands": Tag(LIST, (STRING, ["vanilla"])), "spawn": Tag(COMPOUND, {"pos": Tag(INTS, [0, 0, 0])}),
    }
    rules = {"data": Tag(COMPOUND, {r: Tag(BYTE, 0) for r in OFF}), "DataVersion": Tag(INT, DATA_VERSION)}
    return {LEVEL: gzip.compress(encode_nbt({"Data": Tag(COMPOUND, data)}), mtime=0), RULES: gzip.compress(encode_nbt(rules), mtime=0)}


def capture(archive: bytes) -> dict[str, bytes]:
    """A save's level-wide files as a template: regions and the old level file are left out, name and time are emptied."""
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        out = {n: z.read(n) for n in z.namelist() if n.endswith(".dat") and "/region/" not in f"/{n}"}
    if LEVEL not in out:
        raise ValueError("the archive has no level.dat")
    return out | {LEVEL: filled(out[LEVEL], None, "", 0)}


def filled(level: bytes, spawn: tuple[int, int, int] | None, name: str, played_ms: int) -> bytes:
    """level.dat with values put in; every tag keeps its type."""
    root, tree = decode_nbt(level)
    data = tree["Data"][1]
    if data["DataVersion"][1] != DATA_VERSION:
        raise ValueError(f"the template is of version {data['DataVersion'][1]}")
    put = lambda into, key, value: into.__setitem__(key, Tag(into[key][0], value))
    if spawn is not None:
        put(data["spawn"][1], "pos", list(spawn))
    put(data, "LevelName", name)
    put(data, "LastPlayed", played_ms)
    return gzip.compress(encode_nbt(tree, root), mtime=0)


def write_level(folder: str, spawn: tuple[int, int, int], name: str, played_ms: int, template: dict[str, bytes] | None = None) -> None:
    """The level-wide files (a few KB) into a world's folder."""
    files = dict(template or default_template())
    files[LEVEL] = files[LEVEL_OLD] = filled(files[LEVEL], spawn, name, played_ms)
    fs, path = resolve(folder)
    for at, content in sorted(files.items()):
        fs.create_dir(f"{path}/{at}".rpartition("/")[0], recursive=True)
        with fs.open_output_stream(f"{path}/{at}") as f:
            f.write(content)


def level_faults(folder: str, spawn: tuple[int, int, int]) -> list[str]:
    """What a world's level-wide files say against the export's rules."""
    fs, path = resolve(folder)
    read = lambda at: decode_nbt(fs.open_input_file(f"{path}/{at}").read())[1]
    data, rules = read(LEVEL)["Data"][1], read(RULES)["data"][1]
    checks = {
        "spawn": list(data["spawn"][1]["pos"][1]) == list(spawn), "version": data["DataVersion"][1] == DATA_VERSION,
        "defaults": (data["GameType"][1], data["allowCommands"][1], data["difficulty_settings"][1]["difficulty"][1]) == (GAME_TYPE, COMMANDS, DIFFICULTY),
        "rules": all(rules[r][1] == 0 for r in OFF),
    }
    return [k for k, good in checks.items() if not good]
