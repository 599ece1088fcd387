"""Fixed schemas; nothing is ever inferred."""

from __future__ import annotations

_FACTS = """
project_id string, path string, piece int,
error struct<line:int,column:int,message:string>,
has_main_guard boolean, exports array<string>,
bindings array<struct<name:string,qualname:string,kind:string,line:int,column:int,scope_kind:string,read_count:int,typing_only:boolean,origin:string>>,
imports array<struct<line:int,column:int,module:string,level:int,imported:string,alias:string,wildcard:boolean>>,
unreachable array<struct<line:int,column:int,symbol:string,scope:string,end_line:int,end_offset:int>>,
uses array<struct<caller:string,kind:string,owner:string,attr:string,call:boolean,walk:boolean>>,
decorators array<struct<qualname:string,name:string,arguments:array<string>>>,
dynamic_markers array<struct<name:string,line:int,symbols:array<string>>>,
returns array<struct<qualname:string,annotation:string,line:int>>,
body_hashes array<struct<qualname:string,name:string,digest:string,statements:int,line:int>>,
ignores array<struct<line:int,rules:array<string>,exact:boolean,reason:string,origin:int,reportable:boolean>>,
class_bases array<struct<class:string,bases:array<struct<kind:string,target:string,leaf:string>>>>,
setting_strings array<struct<owner:string,text:string>>,
abstract array<string>, unbound_names array<string>, dynamic_imports array<string>, import_probes array<string>,
lambda_mentions array<string>, module_strings array<string>, module_sweeps array<string>, words array<string>
"""
FACTS = " ".join(_FACTS.split())

#: Columns of a finding, in report order.
FINDING = ["project_id", "id", "rule", "path", "line", "column", "symbol", "qualname", "kind", "status", "confidence", "message", "evidence", "reasons", "fingerprint", "baselined"]
