"""Compiled XML, written here chunk by chunk, read back as tables."""

import io
import struct
import zipfile

from relafix.plans import vulnerabilities
from relafix.sources import binary_xml


def compiled(tree):
    """Compiled form of (tag, attributes, children); values are text, whole numbers or truth values."""
    names: list[str] = []

    def number(text):
        if text not in names:
            names.append(text)
        return names.index(text)

    def chunk(kind, head, body):
        return struct.pack("<HHI", kind, 8 + len(head), 8 + len(head) + len(body)) + head + body

    def element(node):
        tag, attributes, children = node
        cells = b""
        for key, value in attributes.items():
            raw = number(value) if isinstance(value, str) else 0xFFFFFFFF
            typed, data = (3, raw) if isinstance(value, str) else (0x12, 0xFFFFFFFF * value) if isinstance(value, bool) else (0x10, value)
            cells += struct.pack("<IIIHBBI", 0xFFFFFFFF, number(key), raw, 8, 0, typed, data)
        line = struct.pack("<II", 1, 0xFFFFFFFF)
        start = chunk(0x0102, line, struct.pack("<IIHHHHHH", 0xFFFFFFFF, number(tag), 20, 20, len(attributes), 0, 0, 0) + cells)
        return start + b"".join(map(element, children)) + chunk(0x0103, line, struct.pack("<II", 0xFFFFFFFF, number(tag)))

    body = element(tree)
    texts, offsets = b"", b""
    for name in names:
        offsets += struct.pack("<I", len(texts))
        texts += struct.pack("<H", len(name)) + name.encode("utf-16-le") + b"\0\0"
    pool = chunk(0x0001, struct.pack("<IIIII", len(names), 0, 0, 28 + len(offsets), 0), offsets + texts)
    return struct.pack("<HHI", 0x0003, 8, 8 + len(pool) + len(body)) + pool + body


TREE = ("manifest", {"package": "a.b"}, [
    ("uses-sdk", {"targetSdkVersion": 15}, []),
    ("uses-permission", {"name": "p.CAMERA"}, []),
    ("application", {"debuggable": True}, [
        ("activity", {"name": ".Main"}, [("intent-filter", {}, [("action", {"name": "MAIN"}, [])])]),
        ("service", {"name": "Plain", "exported": False}, []),
        ("receiver", {"name": "c.d.Far", "enabled": False, "exported": True}, []),
    ]),
])


def test_manifest(spark, tmp_path):
    (tmp_path / "apps").mkdir()
    raw = compiled(TREE)
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as archive:
        archive.writestr("AndroidManifest.xml", raw)
    (tmp_path / "apps" / "a.apk").write_bytes(box.getvalue())
    (tmp_path / "apps" / "bad.apk").write_bytes(b"PK nothing")
    nodes = binary_xml.read_nodes(spark, str(tmp_path / "apps"))
    assert nodes.where("error is not null").count() == 1
    tables = binary_xml.manifest(nodes)
    assert sorted((r.name, r.type, r.n_filters) for r in tables["component"].collect()) == [("a.b.Main", "activity", 1), ("a.b.Plain", "service", 0), ("c.d.Far", "receiver", 0)]
    assert [r.name for r in vulnerabilities.exported_components(tables["component"]).collect()] == ["a.b.Main"]
    app = tables["app"].first()
    assert (app.package, app.target_sdk, app.debuggable, app.allow_backup) == ("a.b", 15, True, None)
    assert sorted(r.desc for r in vulnerabilities.manifest_findings(tables["app"]).collect()) == ["backup is not disabled", "debuggable", "target level below 17"]
    assert [r.permission for r in tables["permission"].collect()] == ["p.CAMERA"]
    assert [(r.what, r.value) for r in tables["filter"].collect()] == [("action", "MAIN")]
