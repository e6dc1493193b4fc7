"""Row types. Offsets are code points from 0 with an inclusive end; a token's ``value`` is its replacement if it has one."""

ENTITY = "struct<type:string,tag:string,target_uid:string,metadata:map<string,string>>"
TOKEN = f"struct<span_ix:int,ix:int,begin:int,end:int,value:string,original:string,replacement:string,pos:string,lemma:string,head:int,dep:string,frequency:float,entities:array<{ENTITY}>,metadata:map<string,string>>"
SPAN = "struct<ix:int,begin:int,end:int>"
FINDING = "struct<start:int,end:int,entity_type:string,score:float>"
DOCUMENT = f"struct<doc_id:long,lang:string,text:string,labels:array<string>,metadata:map<string,string>,spans:array<{SPAN}>,tokens:array<{TOKEN}>>"
#: A token as tokenizers make it.
PIECE = "struct<ix:int,begin:int,end:int,value:string,kind:string>"
