"""Schemas of the program-fact tables."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "files": "path string, name string, suffix string, is_link boolean, length bigint, content binary",
    "front_occurrence": "path string, source string, kind string, value string, checked boolean",
    "js_citations": "script string, html_path string",
    "bin_strings": "bin string, off bigint, s string",
    "keywords": "name string, source string, text_files array<string>",
    "matches": "bin string, kind string, name string, match_str string, full_str string",
    "border_rank": "name string, strings_count bigint, keywords array<string>, functions array<string>, "
    "keywords_count bigint, functions_count bigint, keyword_source_files array<string>, function_source_files array<string>",
    "functions": "bin string, func string, entry bigint, end_addr bigint, param_count int",
    "call_edges": "bin string, caller string, call_addr bigint, callee string, kind string",
    "call_args": "bin string, call_addr bigint, pos int, const_str string",
    "string_refs": "bin string, str_addr bigint, s string, ref_addr bigint, ref_kind string",
    "role_info": "bin string, key_addr bigint, role string, datakey string, cpf string, x_ref_fun bigint, caller_bb bigint, "
    "role_fun bigint, role_ins bigint, role_ins_idx int, comm_buf string, par_n int",
    "sink_paths": "bin string, param string, str_addr bigint, start_func string, ref_addr bigint, "
    "path array<struct<addr: bigint, callee: string, digest: boolean>>",
    "taint_cases": "str_addr bigint, ref_addr bigint, trace array<bigint>, sinks array<bigint>",
    "sinks": "name string, class string, arg_positions array<int>",
    "summaries": "fn string, effect string, src_pos int, dst_pos int",
    "blocks": "bin string, func string, block bigint, succ bigint, kind string",
    "uses": "block bigint, idx int, var string",
    "guards": "block bigint, op string, lhs_var string, rhs_var string, rhs_const bigint",
    "func_stats": "bin string, func bigint, n_blocks bigint, n_branch bigint, n_memcmp bigint, net_marks bigint, net_checked boolean",
    "device_service": "service_id string, service_type string, control_url string, scpd_url string, "
    "statevars array<struct<name: string, datatype: string, allowed_values: array<string>, send_events: boolean>>, "
    "actions array<struct<name: string, args: array<struct<name: string, direction: string, statevar: string>>>>",
}


def schema(table: str) -> StructType:
    """The schema of one fact table by name."""
    return StructType.fromDDL(_DDL[table])
