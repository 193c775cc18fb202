"""Declared table layouts."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: names and types of the columns of the input tables, in table order. ------
ERAB_ATTEMPTS = [
    "ERAB_EstabInitAttNbr_QCI1",
    "ERAB_EstabInitAttNbr_QCI2",
    "ERAB_EstabInitAttNbr_QCI3",
    "ERAB_EstabInitAttNbr_QCI4",
    "ERAB_EstabInitAttNbr_QCI5",
    "ERAB_EstabInitAttNbr_QCI6",
    "ERAB_EstabInitAttNbr_QCI7",
    "ERAB_EstabInitAttNbr_QCI8",
    "ERAB_EstabInitAttNbr_QCI9",
]
ERAB_SUCCESSES = [
    "ERAB_EstabInitSuccNbr_QCI1",
    "ERAB_EstabInitSuccNbr_QCI2",
    "ERAB_EstabInitSuccNbr_QCI3",
    "ERAB_EstabInitSuccNbr_QCI4",
    "ERAB_EstabInitSuccNbr_QCI5",
    "ERAB_EstabInitSuccNbr_QCI6",
    "ERAB_EstabInitSuccNbr_QCI7",
    "ERAB_EstabInitSuccNbr_QCI8",
    "ERAB_EstabInitSuccNbr_QCI9",
]
ERAB_RELEASES = [
    "ERAB_RelActNbr_QCI1",
    "ERAB_RelActNbr_QCI2",
    "ERAB_RelActNbr_QCI3",
    "ERAB_RelActNbr_QCI4",
    "ERAB_RelActNbr_QCI5",
    "ERAB_RelActNbr_QCI6",
    "ERAB_RelActNbr_QCI7",
    "ERAB_RelActNbr_QCI8",
    "ERAB_RelActNbr_QCI9",
]
PERFORMANCE = T.StructType(
    [
        T.StructField("enodeb_id", T.StringType(), False),
        T.StructField("cell_id", T.StringType(), False),
        T.StructField("measurement_end", T.TimestampType(), False),
        T.StructField("RRC_ConnEstabAtt", T.LongType()),
        T.StructField("RRC_ConnEstabAtt_Em", T.LongType()),
        T.StructField("RRC_ConnEstabAtt_Hpa", T.LongType()),
        T.StructField("RRC_ConnEstabAtt_Mod", T.LongType()),
        T.StructField("RRC_ConnEstabAtt_Mos", T.LongType()),
        T.StructField("RRC_ConnEstabAtt_Mta", T.LongType()),
        T.StructField("RRC_ConnReEstabAtt", T.LongType()),
        T.StructField("RRC_ConnReEstabAtt_Dta", T.LongType()),
        T.StructField("RRC_ConnReEstabAtt_Em", T.LongType()),
        T.StructField("RRC_ConnReEstabAtt_Hpa", T.LongType()),
        T.StructField("RRC_ConnReEstabAtt_Mod", T.LongType()),
        T.StructField("RRC_ConnReEstabAtt_Mos", T.LongType()),
        T.StructField("RRC_ConnReEstabAtt_Mta", T.LongType()),
        T.StructField("RRC_ConnEstabSucc", T.LongType()),
        T.StructField("RRC_ConnEstabSucc_Em", T.LongType()),
        T.StructField("RRC_ConnEstabSucc_Hpa", T.LongType()),
        T.StructField("RRC_ConnEstabSucc_Mod", T.LongType()),
        T.StructField("RRC_ConnEstabSucc_Mos", T.LongType()),
        T.StructField("RRC_ConnEstabSucc_Mta", T.LongType()),
        T.StructField("RRC_ConnMax", T.LongType()),
        T.StructField("S1SIG_ConnEstabAtt", T.LongType()),
        T.StructField("S1SIG_ConnEstabAtt_Em", T.LongType()),
        T.StructField("S1SIG_ConnEstabAtt_Hpa", T.LongType()),
        T.StructField("S1SIG_ConnEstabAtt_Mod", T.LongType()),
        T.StructField("S1SIG_ConnEstabAtt_Mos", T.LongType()),
        T.StructField("S1SIG_ConnEstabAtt_Mta", T.LongType()),
        T.StructField("S1SIG_ConnEstabSucc", T.LongType()),
        T.StructField("S1SIG_ConnEstabSucc_Em", T.LongType()),
        T.StructField("S1SIG_ConnEstabSucc_Hpa", T.LongType()),
        T.StructField("S1SIG_ConnEstabSucc_Mod", T.LongType()),
        T.StructField("S1SIG_ConnEstabSucc_Mos", T.LongType()),
        T.StructField("S1SIG_ConnEstabSucc_Mta", T.LongType()),
        T.StructField("ERAB_EstabInitAttNbr_QCI1", T.LongType()),
        T.StructField("ERAB_EstabInitAttNbr_QCI2", T.LongType()),
        T.StructField("ERAB_EstabInitAttNbr_QCI3", T.LongType()),
        T.StructField("ERAB_EstabInitAttNbr_QCI4", T.LongType()),
        T.StructField("ERAB_EstabInitAttNbr_QCI5", T.LongType()),
        T.StructField("ERAB_EstabInitAttNbr_QCI6", T.LongType()),
        T.StructField("ERAB_EstabInitAttNbr_QCI7", T.LongType()),
        T.StructField("ERAB_EstabInitAttNbr_QCI8", T.LongType()),
        T.StructField("ERAB_EstabInitAttNbr_QCI9", T.LongType()),
        T.StructField("ERAB_EstabInitSuccNbr_QCI1", T.LongType()),
        T.StructField("ERAB_EstabInitSuccNbr_QCI2", T.LongType()),
        T.StructField("ERAB_EstabInitSuccNbr_QCI3", T.LongType()),
        T.StructField("ERAB_EstabInitSuccNbr_QCI4", T.LongType()),
        T.StructField("ERAB_EstabInitSuccNbr_QCI5", T.LongType()),
        T.StructField("ERAB_EstabInitSuccNbr_QCI6", T.LongType()),
        T.StructField("ERAB_EstabInitSuccNbr_QCI7", T.LongType()),
        T.StructField("ERAB_EstabInitSuccNbr_QCI8", T.LongType()),
        T.StructField("ERAB_EstabInitSuccNbr_QCI9", T.LongType()),
        T.StructField("ERAB_EstabAddAttNbr_QCI", T.StringType()),
        T.StructField("ERAB_EstabAddSuccNbr_QCI", T.StringType()),
        T.StructField("ERAB_SessionTimeQCI_QCI", T.StringType()),
        T.StructField("ERAB_RelActNbr_QCI1", T.LongType()),
        T.StructField("ERAB_RelActNbr_QCI2", T.LongType()),
        T.StructField("ERAB_RelActNbr_QCI3", T.LongType()),
        T.StructField("ERAB_RelActNbr_QCI4", T.LongType()),
        T.StructField("ERAB_RelActNbr_QCI5", T.LongType()),
        T.StructField("ERAB_RelActNbr_QCI6", T.LongType()),
        T.StructField("ERAB_RelActNbr_QCI7", T.LongType()),
        T.StructField("ERAB_RelActNbr_QCI8", T.LongType()),
        T.StructField("ERAB_RelActNbr_QCI9", T.LongType()),
        T.StructField("ERAB_SessionTimeUE", T.LongType()),
        T.StructField("UL_RSSI", T.LongType()),
    ]
)

CELL_TRACES = T.StructType(
    [
        T.StructField("procedure_type", T.StringType()),
        T.StructField("starttime", T.TimestampType()),
        T.StructField("endtime", T.TimestampType()),
        T.StructField("imsi", T.StringType()),
        T.StructField("imeisv", T.StringType()),
        T.StructField("msisdn", T.StringType()),
        T.StructField("start_enodeb_id", T.StringType()),
        T.StructField("start_cell_id", T.StringType()),
        T.StructField("start_mme", T.StringType()),
        T.StructField("end_enodeb_id", T.StringType()),
        T.StructField("end_cell_id", T.StringType()),
        T.StructField("end_mme", T.StringType()),
        T.StructField("gummei", T.StringType()),
        T.StructField("bearer_id", T.LongType()),
        T.StructField("qci", T.LongType()),
        T.StructField("pdcp_bitrate_dl", T.DoubleType()),
        T.StructField("pdcp_volume_dl", T.DoubleType()),
        T.StructField("pdcp_bitrate_ul", T.DoubleType()),
        T.StructField("pdcp_volume_ul", T.DoubleType()),
        T.StructField("sgw_bytes_sent_dl", T.DoubleType()),
        T.StructField("sgw_pkts_sent_dl", T.LongType()),
        T.StructField("sgw_bytes_recvd_ul", T.DoubleType()),
        T.StructField("sgw_pkts_recvd_ul", T.LongType()),
        T.StructField("rrc_conn_setup_timestamp_start", T.TimestampType()),
        T.StructField("rrc_conn_setup_rrc_result", T.StringType()),
        T.StructField("rrc_conn_setup_rrc_establ_cause", T.LongType()),
        T.StructField("rrc_conn_setup_duration", T.DoubleType()),
        T.StructField("s1_sig_conn_setup_timestamp_start", T.TimestampType()),
        T.StructField("s1_sig_conn_setup_sig_conn_result", T.StringType()),
        T.StructField("s1_sig_conn_setup_rrc_establ_cause", T.StringType()),
        T.StructField("s1_sig_conn_setup_duration", T.LongType()),
        T.StructField("initial_ctxt_setup_timestamp_start", T.TimestampType()),
        T.StructField("initial_ctxt_setup_initial_ctxt_result", T.StringType()),
        T.StructField("initial_ctxt_setup_erab_result_array", T.StringType()),
        T.StructField("initial_ctxt_setup_duration", T.LongType()),
        T.StructField("initial_ctxt_setup_erab_qci_array", T.StringType()),
        T.StructField("initial_ctxt_setup_3gpp_cause_group", T.LongType()),
        T.StructField("initial_ctxt_setup_3gpp_cause", T.LongType()),
        T.StructField("ue_capability_timestamp", T.TimestampType()),
        T.StructField("ue_capability_cap_category", T.LongType()),
        T.StructField("erab_setup_timestamp_start", T.TimestampType()),
        T.StructField("erab_setup_erab_result_array", T.StringType()),
        T.StructField("erab_setup_erab_qci_array", T.StringType()),
        T.StructField("erab_setup_duration", T.LongType()),
        T.StructField("rrc_conn_reestablish_timestamp_start", T.TimestampType()),
        T.StructField("rrc_conn_reestablish_reestab_result", T.StringType()),
        T.StructField("rrc_conn_reestablish_duration", T.LongType()),
        T.StructField("rrc_conn_reestablish_reestab_cause", T.StringType()),
        T.StructField("erabrelease_starttime", T.TimestampType()),
        T.StructField("erabrelease_release_result", T.StringType()),
        T.StructField("erabrelease_duration", T.LongType()),
        T.StructField("erabrelease_s1_release_cause", T.StringType()),
        T.StructField("erabrelease_internal_release_cause", T.LongType()),
        T.StructField("erabrelease_erab_req_qci_array", T.StringType()),
        T.StructField("erabrelease_erab_req_3gpp_cause_group_array", T.StringType()),
        T.StructField("erabrelease_erab_req_3gpp_cause_array", T.StringType()),
        T.StructField("enb_uectxtrelease_starttime", T.TimestampType()),
        T.StructField("enb_uectxtrelease_duration", T.LongType()),
        T.StructField("enb_uectxtrelease_triggering_node", T.LongType()),
        T.StructField("enb_uectxtrelease_ue_release_cause", T.LongType()),
        T.StructField("enb_uectxtrelease_internal_release_cause", T.LongType()),
        T.StructField("enb_uectxtrelease_3gpp_cause_group", T.LongType()),
        T.StructField("enb_uectxtrelease_3gpp_cause", T.LongType()),
        T.StructField("enb_uectxtrelease_erab_release_req_qci_array", T.StringType()),
        T.StructField("uemeasment_sample_meastime", T.TimestampType()),
        T.StructField("uemeasment_sample_power_headroom", T.DoubleType()),
        T.StructField("uemeasment_sample_power_headroom_prb_used", T.LongType()),
        T.StructField("uemeasment_sample_last_pusch_num_prb", T.LongType()),
        T.StructField("uemeasment_sample_last_pusch_sinr", T.DoubleType()),
        T.StructField("uemeasment_sample_last_pusch_power_per_prb", T.DoubleType()),
        T.StructField("uetrafficrep_sample_meastime", T.TimestampType()),
        T.StructField("uetrafficrep_sample_thp_pdcpvol_trunk_dl", T.DoubleType()),
        T.StructField("uetrafficrep_sample_thp_time_dl", T.LongType()),
        T.StructField("uetrafficrep_sample_thp_pdcpvol_trunk_ul", T.DoubleType()),
        T.StructField("uetrafficrep_sample_thp_time_ul", T.LongType()),
        T.StructField("uerbtrafficrep_sample_meastime", T.TimestampType()),
        T.StructField("uerbtrafficrep_sample_bearer_id", T.LongType()),
        T.StructField("uerbtrafficrep_sample_erab_id", T.LongType()),
        T.StructField("uerbtrafficrep_sample_bearer_type", T.StringType()),
        T.StructField("uerbtrafficrep_sample_drb_pdcp_ackvol_dl", T.DoubleType()),
        T.StructField("uerbtrafficrep_sample_drb_pdcp_transvol_dl", T.DoubleType()),
        T.StructField("uerbtrafficrep_sample_drb_pdcp_recvol_ul", T.DoubleType()),
    ]
)
# --- End of fixed values. --------------------------------------------------------------------

MISSED_KPI = T.StructType(
    [T.StructField("kpi", T.StringType(), False), T.StructField("value", T.DoubleType(), False)]
)

INCIDENTS = T.StructType(
    [
        T.StructField("incident_id", T.StringType(), False),
        T.StructField("start_ts", T.TimestampType(), False),
        T.StructField("end_ts", T.TimestampType()),
        T.StructField("status", T.StringType(), False),
        T.StructField("description", T.StringType(), False),
        T.StructField("kpi_missed", T.ArrayType(MISSED_KPI, False), False),
        T.StructField("enodeb_id", T.StringType()),
        T.StructField("cell_id", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("preliminary_analysis", T.StringType()),
        T.StructField("final_analysis", T.StringType()),
        T.StructField("events", T.StringType()),
        T.StructField("events_embeddings", T.ArrayType(T.DoubleType(), False), False),
        T.StructField("cause", T.StringType()),
        T.StructField("resolution", T.StringType()),
        T.StructField("created_ts", T.TimestampType(), False),
    ]
)

# The content of one rule file; ``rule_id`` comes from the file name.
RULE_DOCUMENT = T.StructType(
    [
        T.StructField("description", T.StringType()),
        T.StructField("kpi_missed", T.ArrayType(T.StringType())),
        T.StructField("processing_rule", T.StringType()),
        T.StructField("processing_rule_tools", T.ArrayType(T.StringType())),
        T.StructField("severity_determination_rule", T.StringType()),
        T.StructField("severity_determination_rule_tools", T.ArrayType(T.StringType())),
        T.StructField("vendor", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("creation_date", T.StringType()),
        T.StructField("is_current", T.BooleanType()),
    ]
)

REFERENCE = T.StructType(
    [T.StructField("url", T.StringType()), T.StructField("title", T.StringType())]
)

ACTION = T.StructType(
    [
        T.StructField("tool_name", T.StringType()),
        T.StructField("reason_to_perform", T.StringType()),
        T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
        T.StructField("status", T.StringType()),
    ]
)
