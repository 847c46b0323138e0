"""Known answers of the standards' encodings."""

import datetime as dt

import pytest

from tsloom.functions import mp4, tables, text, wire
from tsloom.operators import scte, units
from tsloom.operators.scte import splice_info
from tsloom.sources import synth as S
from tsloom.sources.packets import Realigner


def test_broadcast_text():
    assert text.dvb_text(b"T\xc2el\xc2e Un") == "Télé Un"
    assert text.dvb_text(b"\x0bRundfunk \xd6st") == "Rundfunk Öst"
    assert text.dvb_text(b"\xeauvre \xbd \xf1on\x8a\xe9") == "Œuvre ½ æon\nØ"
    assert text.dvb_text(b"\x10\x00\x0f\xa4") == "€" and text.dvb_text(b"\x10\x00") == ""
    assert text.dvb_text(b"\x11\x00A\x20\xac") == "A€" and text.dvb_text(b"\x15\xc3\xa9") == "é"
    assert text.dvb_text(b"\x08\x41") == text.LOST and text.dvb_text(b"\x1fabc") == text.LOST * 3 and text.dvb_text(b"\x1f") == text.LOST
    assert text.dvb_text(b"$a\x86b\xc2") == "¤ab" + text.LOST and text.dvb_text(b"\xc9e") == text.LOST + "e" and text.dvb_text(b"") == "" and text.dvb_text(None) is None


def test_times_and_codecs():
    assert text.start_time(bytes([0xEE, 0x2A]) + b"\x20\x00\x00").strftime("%H:%M") == "20:00"
    assert text.start_time(b"\xff" * 5) is None and text.start_time(b"\xc0\x79\x24\0\0") is None
    assert text.start_time(b"\xc0\x79\x1a\0\0").hour == 20  # digits over nine carry
    assert text.start_time(b"\xc0\x79\x12\x45\0") == dt.datetime(1993, 10, 13, 12, 45)
    assert text.duration(b"\x01\x45\x30") == 6330 and text.duration(b"\x01\x60\x00") == 0
    assert text.avc_codec(bytes.fromhex("6742c00b")) == "avc1.42c00b"
    sps = bytes.fromhex("420101" "01" "60000000" "900000000000" "3c")
    assert text.hevc_codec(sps) == "hev1.1.6.L60.90"
    with pytest.raises(ValueError):
        text.avc_codec(b"\x67\x42")


def test_checksum_and_pes():
    assert wire.crc32_mpeg(b"123456789") == 0x0376E6E7
    assert wire.crc_ok(S.pat(1, {1: 32})) and not wire.crc_ok(b"abc")
    head = wire.pes_header(S.pes(0xE0, b"x", 133200, 126000))
    assert (head["stream_id"], head["pts"], head["dts"], head["header_length"]) == (0xE0, 133200, 126000, 19)
    assert wire.pes_header(S.pes(0xC0, b"", 2**33 - 1))["pts"] == 2**33 - 1
    assert wire.pes_header(b"\0\0\1\xbe\0\4xxxx") == {"stream_id": 0xBE, "packet_length": 4, "pts": None, "dts": None, "data_alignment": False, "header_length": 6}
    assert wire.pes_header(b"\0\0\2\xe0\0\0") is None and wire.pes_header(b"\0\0\1\xe0") is None
    odd = bytearray(S.pes(0xE0, b"", 5))
    odd[7] = 0x40
    assert wire.pes_header(bytes(odd))["pts"] is None


def test_sections():
    big = S.section(0x80, 7, bytes(range(256)) * 3)
    for pointer in (0, 5):
        s = tables.Sections()
        got = [x for i, p in enumerate(S.section_payloads(big, pointer)) for x in s.feed(p, i == 0, False)]
        assert [x["body"] for x in got] == [bytes(range(256)) * 3] and s.completed == 1
    a, b = S.section(1, 1, b"a" * 10), S.section(1, 2, b"b" * 10)
    assert [x["ext"] for x in tables.Sections().feed((b"\0" + a + b).ljust(184, b"\xff"), True, False)] == [1, 2]
    s = tables.Sections()
    assert not s.feed(S.section_payloads(S.section(1, 1, b"x", spoil=True))[0], True, False) and s.crc_errors == 1
    assert not tables.Sections().feed(b"tail without start".ljust(184, b"\0"), False, False)
    s, parts = tables.Sections(), S.section_payloads(big)
    s.feed(parts[0], True, False)
    assert not s.feed(b"", False, True) and not s.feed(parts[1], False, False)
    s = tables.Sections()
    assert not s.feed(bytes([181]) + b"\xff" * 181 + a[:2], True, False)
    assert [x["ext"] for x in s.feed(a[2:].ljust(184, b"\xff"), False, False)] == [1]
    short = b"\x70\x30\x02ab"
    got = tables.Sections().feed((b"\0" + short).ljust(184, b"\xff"), True, False)
    assert got[0]["body"] == short and not got[0]["is_long"]


def test_table_parsers():
    one = lambda raw: tables.Sections().feed(S.section_payloads(raw)[0], True, False)[0]
    t = tables.pat(one(S.pat(9, {0: 16, 1: 4096, 2: 4097})))
    assert t == {"ts_id": 9, "network_pid": 16, "programs": [{"program": 1, "pid": 4096}, {"program": 2, "pid": 4097}]}
    m = tables.pmt(one(S.pmt(3, 256, [(0x1B, 256), (0x0F, 257, S.descriptor(10, b"eng\0fra\0"))], S.descriptor(5, b"HDMV"))))
    assert (m["program"], m["pcr_pid"], m["registration"]) == (3, 256, "HDMV") and m["streams"][1]["languages"] == ["eng", "fra"]
    assert tables.pmt({"ext": 1, "body": b"\xe1\0\xf0\x20"}) is None
    assert [s["name"] for s in tables.sdt(one(S.sdt(1, [(1, "Café"), (2, "B")])))["services"]] == ["Café", "B"]
    body = bytes([0xF0, 8]) + S.descriptor(0x40, b"FFmpeg") + bytes([0xF0, 12, 0, 1, 0xFF, 1, 0xF0, 6]) + S.descriptor(0x41, b"\0\1\1x")[:6]
    n = tables.nit({"ext": 0xFF01, "body": body})
    assert n["name"] == "FFmpeg" and n["streams"][0]["services"] == [{"service_id": 1, "type": 1}]
    assert wire.descriptors(b"\x05\x01a\x06\x09b", 0, 6) == [{"tag": 5, "payload": b"a"}]
    assert tables.service_descriptor(b"\x01\x05ab")["name"] is None and tables.short_event(b"eng\x01a\x01b") == {"language": "eng", "name": "a", "text": "b"}


def test_splice_information():
    insert = (1001).to_bytes(4, "big") + b"\x7f\xef" + (0xFE << 32 | 403200).to_bytes(5, "big") + (0xFE << 32 | 180000).to_bytes(5, "big") + b"\0\1\1\2"
    s = splice_info(S.splice_info(5, insert))
    i = s["splice_insert"]
    assert (i["event_id"], i["out_of_network"], i["splice_time"], i["duration"], i["auto_return"], i["program_id"], i["avail_num"], i["avails_expected"]) == (1001, True, 403200, 180000, True, 1, 1, 2)
    upid = b"ABCD0123456H"
    seg = b"CUEI" + (7).to_bytes(4, "big") + b"\x7f\xff" + (180000).to_bytes(5, "big") + bytes([3, len(upid)]) + upid + b"\x34\0\0"
    g = splice_info(S.splice_info(6, b"\xfe\0\0\0\1", S.descriptor(9, b"zz") + S.descriptor(2, seg)))["segmentations"][0]
    assert (g["type"], g["upid_text"], g["duration"], g["delivery_restricted"]) == (0x34, "ABCD0123456H", 180000, False)
    assert splice_info(S.splice_info(5, b"\0\0\0\7\xff"))["splice_insert"]["cancelled"]
    assert splice_info(S.splice_info(6, b"\xfe\0\0\0\1", adjust=2**33 - 1))["pts_adjustment"] == 2**33 - 1
    assert splice_info(S.splice_info(5, b"xx", encrypted=True))["encrypted"]
    assert splice_info(S.splice_info(5, insert[:8])) is None and splice_info(S.splice_info(0, b"")[:-1] + b"x") is None
    assert splice_info(S.splice_info(6, b"\xfe\0\0\0\1", S.descriptor(2, seg), length=0xFFF))["segmentations"] == []
    parts = b"CUEI" + (7).to_bytes(4, "big") + b"\x7f\x7f\x02" + bytes(12) + (90000).to_bytes(5, "big") + b"\x08\x01\xff\x30\x01\x02"
    g = splice_info(S.splice_info(6, b"\xfe\0\0\0\1", S.descriptor(2, parts)))["segmentations"][0]
    assert (g["duration"], g["upid_text"], g["type"], g["segment_num"], g["segments_expected"]) == (90000, "FF", 0x30, 1, 2)  # components are stepped over
    assert scte.upid_text(8, b"\x01\xab") == "01AB"


def test_nal_splitters_differ():
    data = b"\0\0\1\x65a\0\0\0\0\1\x41b\0\0"
    assert units.nal_units(data) == [b"\x65a", b"\x41b"]
    assert mp4.annexb_units(data) == [b"\x65a\0", b"\x41b\0\0"]
    assert mp4.length_prefixed([b"ab"]) == b"\0\0\0\2ab"


def test_boxes_and_audio():
    sps = bytes.fromhex("6764000cacd941419f9f016a02020280000003008000001e078a14cb")
    p = mp4.picture_format(sps)
    assert p.extended and (p.chroma, p.luma_depth) == (1, 0) and p.width % 2 == 0
    box = mp4.avc_config([sps], [b"\x68\xeb\xe3\xcb"])
    assert box[4:8] == b"avcC" and box[8:12] == b"\x01\x64\x00\x0c" and box[-4:] == b"\xfd\xf8\xf8\0"
    frame = lambda n: (0xFFF1 << 40 | 1 << 38 | 4 << 34 | 1 << 30 | (7 + n) << 13 | 0x7FF << 2).to_bytes(7, "big") + bytes(n)
    head = mp4.adts(frame(10))
    assert (head.size, head.header, head.rate, head.channels, head.config) == (17, 7, 44100, 1, b"\x12\x08")
    stream = frame(10) + frame(20) + frame(30)
    whole = mp4.AacTimeline(2)
    one = whole.add(stream, 126000)
    for cut in range(1, len(stream)):
        line = mp4.AacTimeline(2)
        parts = [x for x in (line.add(stream[:cut], 126000), line.add(stream[cut:], None)) if x]
        line.finish()
        assert sum(len(x) - x.index(b"mdat") - 4 for x in parts) == len(one) - one.index(b"mdat") - 4
    assert int.from_bytes(one[one.index(b"tfdt") + 8 : one.index(b"tfdt") + 16], "big") == 61740
    with pytest.raises(ValueError):
        mp4.AacTimeline(2).add(frame(5), None)
    with pytest.raises(ValueError):
        mp4.adts(b"\xff\xf1\x00" + bytes(5))
    init = mp4.init_segment(([sps], [b"\x68\xeb"]), head)
    assert init[4:8] == b"ftyp" and init.count(b"trak") == 2 and b"esds" in init
    with pytest.raises(ValueError):
        mp4.init_segment(([sps], []))
    with pytest.raises(ValueError):
        mp4.fragment(1, 1, [])


def test_realignment_needs_three_sync_bytes():
    p = b"".join(S.packet(1, i, bytes(0x47 if j == 31 * i else i for j in range(184))) for i in range(6))
    r = Realigner()
    assert r.feed(b"\x47abc" + p[:564]) == ([p[:564]], [(0, 4)]) and r.feed(p[564:])[0] == [p[564:]]
    r = Realigner()
    assert r.feed(p[:563]) == ([], []) and r.feed(p[563:600])[0] == [p[:564]]
