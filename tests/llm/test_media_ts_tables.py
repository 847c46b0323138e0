from tsloom.llm import media_ts as M
from tsloom.sources import synth as S


def test_tables_after_damaged_copies_and_over_packets():
    def tables(spoil, k):
        info = b"".join(S.descriptor(5, bytes([i]) * 200) for i in range(3))
        pmt = S.section_payloads(S.pmt(1, 256, [(0x1B, 256)], info=info, spoil=spoil))
        assert len(pmt) > 1
        return [S.packet(0, k, S.section_payloads(S.pat(1, {1: 4096}, spoil=spoil))[0], pusi=True), *(S.packet(4096, len(pmt) * k + i & 15, x, pusi=i == 0) for i, x in enumerate(pmt))]

    media = [x for k in range(6) for x in tables(k < 5, k)]
    media += S.pes_packets(256, 0, S.pes(0xE0, b"payload" * 50, 90000))
    got = M.read(b"".join(media))
    assert (got["program"], got["streams"], got["payload"]) == (1, [(256, 0x1B)], b"payload" * 50)
