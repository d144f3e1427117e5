"""Log parsing on hand-written lines."""

from pyspark.sql import functions as F

from linkops.plans import log_flow
from linkops.sources import logs

LOG = b"""- UE PDSCH: ue=9 c-rnti=0x4601 h_id=3 ss_id=2 tbs=1 mcs=1 rv=0 nrtx=0 k1=4
2025-09-01T18:04:34.6474231 [SCHED] [I] [ 100.1] Slot decisions

- UE PDSCH: ue=0 c-rnti=0x4601 h_id=3 ss_id=2 rb=[0..24) symb=[2..14) tbs=1024 mcs=12 rv=0 nrtx=1 k1=4
2025-09-01T18:04:34.653 [MAC] [D]
- HARQ-ACK: ue=0 rnti=0x4601 slot_rx=100.5 h_id=3 ack=1
2025-09-01T18:04:34.700000 [METRICS] Scheduler UE pci=1 rnti=0x4601 pusch_snr_db=17.5 pusch_mcs=20
- CRC: ue=0 rnti=0x4601 crc=OK sinr=-3.2dB \xff
2025-09-01T18:04:35.000000 [RRC] ue=0 c-rnti=0x4601: Containerized measurementReport
      "rsrp": 70,
      "rsrq": 60,
      "sinr": 66
    }
      "sinr": 1
2025-09-01T18:04:35.100000 [CONFIG] mcs_table: qam64
mcs_table: qam256
2025-09-01T18:04:36.000000 [RRC] ue=1 c-rnti=0x4602: Containerized measurementReport
2025-09-01T18:04:36.000000 [RRC] ue=2 c-rnti=0x4603: Containerized measurementReport
      "rsrp": 10,
olla_target_bler: 0.01
- UE PDSCH: ue=0 c-rnti=0x4601 h_id=4 ss_id=2 rb=[0..24) symb=[2..14) tbs=512 mcs=5 rv=0 nrtx=0 k1=4
"""


def lines(spark, tmp_path):
    path = tmp_path / "gnb.log"
    path.write_bytes(LOG)
    return logs.number_lines(spark, str(path)).where(F.col("value") != "")


def test_events(spark, tmp_path):
    rows = lines(spark, tmp_path)
    events = logs.classified(rows)
    tx = logs.pdsch_events(events).orderBy("ts").collect()
    assert [(r.mcs, r.tbs, r.nrtx, r.rnti) for r in tx] == [(12, 1024, 1, 0x4601), (5, 512, 0, 0x4601)]
    assert tx[0].ts.microsecond == 647423
    fb = logs.harq_events(events).collect()
    assert [(r.ack, r.tbs, r.ts.microsecond) for r in fb] == [(1, None, 653000)]
    assert [r.ul_sinr for r in logs.ul_measurements(events).collect()] == [17.5]
    assert [r.actual_sinr for r in logs.crc_sinr(rows).collect()] == [-3.2]
    assert logs.crc_sinr(rows, compat=True).count() == 0
    config = {r.param: (r.value, r.value_type) for r in logs.config_values(rows).collect()}
    assert config == {"mcs_table": ("qam256", "string"), "olla_target_bler": ("0.01", "float")}


def test_reports_stop_at_brace_and_may_overlap(spark, tmp_path):
    got = {r.ue_id: (r.dl_rsrp, r.dl_rsrq, r.dl_sinr) for r in logs.dl_measurements(lines(spark, tmp_path)).collect()}
    assert got == {0: (-86.0, -13.0, 10.0), 1: (-146.0, None, None), 2: (-146.0, None, None)}


def test_flow(spark, tmp_path):
    out = log_flow.transmissions_from_lines(lines(spark, tmp_path)).orderBy("pdsch_timestamp").collect()
    assert [(r.ack_result, r.ack_status, r.dl_sinr, r.ul_sinr) for r in out] == [
        ("ACK", 1.0, 10.0, 17.5), ("DTX", 2.0, 10.0, 17.5)]
    assert out[0].transmission_type == "retransmission" and out[0].rnti == "0x4601"
    assert abs(out[0].time_diff_ms - 5.577) < 1e-9 and out[1].bler == 0.0
    plain = log_flow.transmissions_from_lines(lines(spark, tmp_path), mode="first", skip_measurements=True, unmatched="unknown")
    assert {r.ack_result for r in plain.collect()} == {"ACK", "UNKNOWN"}
