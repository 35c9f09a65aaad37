"""Listing on executors against a plain walk, and rules as one expression against rules one by one."""

import os
import random
from pathlib import Path

from tessera.sources.discovery import list_tree
from tessera.sources.rules import Ignore


def plain_walk(directory, ignore):
    for top, dirs, names in os.walk(directory):
        here = Path(top).relative_to(directory)
        dirs[:] = sorted(d for d in dirs if not ignore.matches((here / d).as_posix(), directory=True))
        yield from (p for n in sorted(names) if not ignore.matches(p := (here / n).as_posix()))


def test_the_order_of_a_walk(spark, tmp_path):
    rng = random.Random(4)
    names = ["a", "a-", "a.b", "B", "é", "z z", "build", "0", "keep", "~"]
    folders = [tmp_path / "root"]
    folders[0].mkdir()
    for _ in range(60):
        folder = rng.choice(folders) / rng.choice(names)
        if not folder.exists():
            folder.mkdir()
            folders.append(folder)
        file = rng.choice(folders) / f"{rng.choice(names)}{rng.choice(['.md', '.log', '', '.txt'])}"
        if not file.exists():
            file.write_text("x" * rng.randrange(9))
    (folders[0] / "broken.md").symlink_to(tmp_path / "nowhere")
    (folders[0] / "loop").symlink_to(folders[0])
    ignore = Ignore(["*.log", "build/", "!keep/build/", "a-/**/z z/"])
    got = list_tree(spark, folders[0], ignore).orderBy("walk_order").collect()
    assert [r["rel_path"] for r in got] == list(plain_walk(folders[0], ignore)) and len(got) > 20
    for r in got:
        assert (r["error"] or "").startswith("unreadable") if r["rel_path"] == "broken.md" else r["size"] == Path(r["path"]).stat().st_size
    assert list_tree(spark, tmp_path / "missing", ignore).count() == 0


def test_the_last_rule_decides():
    rng = random.Random(9)
    pool = ["*.log", "!keep.log", "build/", "/top", "a/**/b", "!a/x/b", "**/c?", "[ab]*", "![!b]*", "d/", "!d/e", "\\!odd", "*", "!*.md"]
    for _ in range(300):
        rules = [rng.choice(pool) for _ in range(rng.randrange(6))]
        ignore, path = Ignore(rules), "/".join(rng.choice(["a", "b", "x", "keep.log", "c1", "d", "e", "top", "build", "!odd", "n.md"]) for _ in range(rng.randrange(1, 5)))
        for directory in (True, False):
            want = False
            for keep, only, regex in ignore.rules:
                if (directory or not only) and regex.match(path):
                    want = not keep
            assert ignore._own(path, directory) == want, (rules, path)
