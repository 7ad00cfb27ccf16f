"""The SQL (DuckDB) of the registered vessel queries."""

from __future__ import annotations

from wakeline.functions.destination import COUNTRY_GROUPS, NOISE
from wakeline.sources.adapters import NATION_LETTERS

PORTS = f"""
ports as (select s_suppkey as pos, cc||city as portcode, cc as country_code, city as city_code, n_name as country_name, s_name as city_name,
    cast(-60+(s_suppkey*37)%120 as double) as latitude, cast(-180+(s_suppkey*73)%360 as double) as longitude
  from (select s_suppkey, s_name, n_name, substr('{NATION_LETTERS}', cast(2*s_nationkey+1 as int), 2) as cc,
      chr(65+cast(floor(s_suppkey/676) as int)%26)||chr(65+cast(floor(s_suppkey/26) as int)%26)||chr(65+cast(s_suppkey as int)%26) as city
    from supplier join nation on s_nationkey=n_nationkey) x)"""
POSITIONS = """
positions as (select event_id, ts as dt_pos_utc, 200000000+user_id as mmsi,
  case when user_id%29=0 then null when user_id%31=0 then 0 when user_id%37=0 and event_id%2=0 then 9500000+user_id else 9000000+user_id end as imo,
  case when event_id%17=0 then null else value/10 end as sog,
  case event_type when 'error' then 'moored' when 'signup' then 'at anchor' else 'under way' end as nav_status,
  -60+((user_id*13+h)%1200)/10.0::double as latitude, -180+((user_id*29+2*h)%3600)/10.0::double as longitude,
  case event_id%12 when 0 then p.country_code||' '||p.city_code when 1 then p.portcode when 2 then p.city_code||p.country_code
    when 3 then p.country_code||'>'||p.city_code when 4 then 'XXX>'||p.portcode when 5 then 'FOR ORDERS' when 6 then 'OPEN SEA, WAITING'
    when 7 then p.city_name when 8 then '' when 9 then null when 10 then '0902' else 'FR MRS > '||p.country_code||' '||p.city_code||'/' end as destination
  from (select *, cast(floor(epoch(ts)/3600) as bigint) as h from events) e join ports p on p.pos=(e.user_id+cast(floor(h/72) as bigint))%10)"""
SNAPSHOTS = """
snapshots as (select o_orderkey, case when o_custkey%50=0 then null else 9000000+o_custkey end as imo, o_orderdate as snapshot_ts,
  case when o_orderkey%13=0 then null else 'KR'||upper(substr(o_orderpriority,3,3)) end as dest_code from orders)"""
RANKED = """
ranked as (select *, case when o_orderkey%5>0 then 'JP'||cast(o_orderkey%7 as varchar) end as dept_code,
    row_number() over (partition by imo order by snapshot_ts desc, o_orderkey desc) as r from snapshots where imo is not null),
cur as (select * from ranked where r=1), past as (select * from ranked where r=2)"""
WATCH = "watch_list as (select 9000000+c_custkey as imo from customer where c_mktsegment='BUILDING')"


def norm(x: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(lower({x}), '[,.\-/_$#!:?;''&^()*\[\]{{}}%=+`~<>"\n\r\\]', ' ', 'g'), '\s+', ' ', 'g'))"""


def clean(source: str, column: str, name: str) -> str:
    """A common table `name`: the rows of `source` with clean_dest."""
    return f"""
{name}_t as (select *, case when length({column})>30 and contains({column}, '"') then split_part({column}, '"', 1) else {column} end as t_ from {source}),
{name}_p as (select *, string_split(t_, '>') as parts_, list_transform(string_split(t_, '>'), lambda x: {norm("x")}) as norms_ from {name}_t),
{name} as (select * exclude (t_, parts_, norms_), case when contains(t_, '>') and (not contains(t_, '<') or strpos(t_, '<')>strpos(t_, '>')) then
    case when len(parts_)=2 and length(norms_[2])=3 and not contains(norms_[2], ' ') and length(trim(parts_[1]))=2 then lower(trim(parts_[1]))||norms_[2]
      else coalesce(list_filter(list_reverse(norms_), lambda x: length(replace(x, ' ', ''))>=3)[1], norms_[1]) end
    else {norm("t_")} end as clean_dest from {name}_p)"""


CLEANED = clean("positions", "destination", "cleaned")
REGISTERED = clean("(select city_name, portcode from ports where pos%5=0)", "city_name", "registered")


def noise_full(d: str) -> str:
    return "(" + " or ".join(f"regexp_extract({d}, '{p}', 0) = {d}" for p in NOISE) + ")"


def noise_part(d: str) -> str:
    return "(" + " or ".join(f"len(list_filter(regexp_extract_all({d}, '{p}', 0), lambda x: trim(x) <> ''))>0" for p in NOISE) + ")"


def candidates(d: str) -> str:
    w = f"string_split({d}, ' ')"
    return f"""case when len({w})=1 then case when length({d})=5 then [substr({d},4,2)||substr({d},1,3), {d}] else {w} end
  when len({w})=2 then case when length({w}[1])=2 and length({w}[2])=3 then [{w}[1]||{w}[2]] when length({w}[1])=3 and length({w}[2])=2 then [{w}[2]||{w}[1]] else []::varchar[] end
  else list_reverse({w}) end"""


def numeric(d: str) -> str:
    return f"regexp_matches(trim({d}), '^(?:[0-9]+(?:e[0-9]+)?|nan|inf(?:inity)?)$')"


def match(source: str, column: str, name: str) -> str:
    """A common table `name` (column, code): the first known candidate of each distinct text."""
    return f"""
{name}_c as (select {column}, unnest(range(1, len(c)+1)) as try_, unnest(c) as cand from (select {column}, {candidates(f"trim({column})")} as c from (select distinct {column} from {source} where {column} is not null))),
{name}_h as (select {column}, arg_min(portcode, try_*1000000+pos) as code from {name}_c join ports on upper(cand)=portcode where length(cand)=5 group by {column}),
{name} as (select d.{column}, code from (select distinct {column} from {source} where {column} is not null) d left join {name}_h h on d.{column}=h.{column})"""


MATCHED = match("cleaned", "clean_dest", "matched")
GRAMS = "case when length({0})>=3 then list_distinct(list_transform(range(1, length({0})-1), lambda i: substr({0}, i, 3))) else []::varchar[] end"
SCORES = f"""
texts as (select distinct clean_dest from cleaned where clean_dest is not null),
ta as (select clean_dest, len(g) as n, unnest(g) as gram from (select clean_dest, {GRAMS.format("clean_dest")} as g from texts)),
pb as (select pos, portcode, len(g) as m, unnest(g) as gram from (select pos, portcode, {GRAMS.format("lower(city_name)")} as g from ports)),
sh as (select clean_dest, pos, portcode, count(*)/(n+m-count(*))::double as score from ta join pb on ta.gram=pb.gram group by clean_dest, pos, portcode, n, m),
be as (select *, row_number() over (partition by clean_dest order by score desc, pos) as r from sh),
scores as (select t.clean_dest, be.portcode as code, coalesce(round(be.score*100, 2), 0.0) as confidence from texts t left join be on t.clean_dest=be.clean_dest and r=1),
preds as (select clean_dest, case when length(trim(clean_dest))<=2 or {numeric("clean_dest")} then '' else coalesce(code, '') end as pred, confidence from scores)"""
#: The ladder over distinct texts: clean_dest, pred, confidence, code, resolution.
LADDER = f"""
lw as (select *, trim(clean_dest) as d, string_split(trim(clean_dest), ' ')[-1] as lw from preds),
lp as (select *, case when length(d)=5 then d when length(lw)=5 then lw end as probe from lw),
{match("lp", "probe", "probed")},
lj as (select lp.*, p.code as dict from lp left join probed p on lp.probe=p.probe),
ladder as (select clean_dest, pred, confidence,
  case when {noise_full("d")} then '' when confidence>=90 then pred when confidence<50 and {noise_part("d")} then '' when confidence<=10 then '' when dict is not null then dict else pred end as code,
  case when {noise_full("d")} then 'noise' when confidence>=90 then 'model' when confidence<50 and {noise_part("d")} then 'noise' when confidence<=10 then 'low' when dict is not null then 'dictionary' else 'model' end as resolution
  from lj)"""


def distance(a: str, b: str) -> str:
    la, oa, lb, ob = f"{a}latitude", f"{a}longitude", f"{b}latitude", f"{b}longitude"
    return f"2*6371.0088*asin(sqrt(least(1.0, sin(radians({lb}-{la})/2)**2 + cos(radians({la}))*cos(radians({lb}))*sin(radians({ob}-{oa})/2)**2)))"


def group_of(code: str) -> str:
    cases = " ".join(f"when substr({code},1,2) in ({', '.join(repr(c) for c in v.split())}) then '{k}'" for k, v in COUNTRY_GROUPS.items())
    return f"case when length({code})=5 then case {cases} end end"


#: The voyage extraction up to named voyages, radius 500 km.
VOYAGES = f"""
h0 as (select * from positions where imo is not null and imo<>0),
amb as (select mmsi from h0 group by mmsi having count(distinct imo)>1),
h1 as (select * from h0 where mmsi not in (select mmsi from amb)),
h2 as (select * replace (coalesce(sog, (coalesce(b_, a_)+coalesce(a_, b_))/2) as sog) from (select *,
  last_value(sog ignore nulls) over (partition by mmsi order by dt_pos_utc, event_id rows between unbounded preceding and 1 preceding) as b_,
  first_value(sog ignore nulls) over (partition by mmsi order by dt_pos_utc, event_id rows between 1 following and unbounded following) as a_ from h1)),
np as (select distinct event_id from h2 join ports p on {distance("h2.", "p.")}<=500 where sog<=3),
h3 as (select h2.* exclude (a_, b_), coalesce(sog<=3, false) and (1 + (case when row_number() over w>1 and destination is distinct from lag(destination) over w then 1 else 0 end)
   + (case when np.event_id is not null then 1 else 0 end) + (case when nav_status in ('moored','at anchor') then 1 else 0 end))>=2 as stop_
  from h2 left join np on h2.event_id=np.event_id window w as (partition by mmsi order by dt_pos_utc, h2.event_id)),
h4 as (select *, stop_ and not coalesce(lag(stop_) over (partition by mmsi order by dt_pos_utc, event_id), false) as cut from h3),
h5 as (select *, sum(cut::bigint) over (partition by mmsi order by dt_pos_utc, event_id rows unbounded preceding)::bigint as voyage_id from h4)"""
SLICES = f"""
h6 as (select * replace (unnest(case when cut then [voyage_id-1, voyage_id] else [voyage_id] end) as voyage_id) from (select *, max(voyage_id) over (partition by mmsi) as last_ from h5)),
h7 as (select * exclude (last_) from h6 where voyage_id>0 and voyage_id<last_),
s1 as (select *, lag(latitude) over v as la, lag(longitude) over v as lo, lag(dt_pos_utc) over v as lt from h7 window v as (partition by mmsi, voyage_id order by dt_pos_utc, event_id)),
h8 as (select * exclude (la, lo, lt, km_, hr_) from (select *, 2*6371.0088*asin(sqrt(least(1.0, sin(radians(latitude-la)/2)**2+cos(radians(la))*cos(radians(latitude))*sin(radians(longitude-lo)/2)**2))) as km_, epoch_us(dt_pos_utc-lt)/3.6e9 as hr_ from s1)
  where not (coalesce(km_/1.852>40*hr_, false) and coalesce(km_>0, false)) and not coalesce(sog>40, false))"""
SUMMARY = """
s2 as (select *, lag(latitude) over v as la, lag(longitude) over v as lo from h8 window v as (partition by mmsi, voyage_id order by dt_pos_utc, event_id)),
summary as (select mmsi, voyage_id, count(*) as n_points,
  coalesce(sum(2*6371.0088*asin(sqrt(least(1.0, sin(radians(latitude-la)/2)**2+cos(radians(la))*cos(radians(latitude))*sin(radians(longitude-lo)/2)**2)))) filter (la is not null), 0.0) as km,
  min(dt_pos_utc) as started, max(dt_pos_utc) as ended,
  arg_min(latitude, (dt_pos_utc, event_id)) as first_latitude, arg_min(longitude, (dt_pos_utc, event_id)) as first_longitude,
  arg_max(latitude, (dt_pos_utc, event_id)) as last_latitude, arg_max(longitude, (dt_pos_utc, event_id)) as last_longitude from s2 group by mmsi, voyage_id)"""


def geodesics(source: str, rounds: int = 40) -> list[str]:
    """Common tables gd0 to gd_end: `source` (latitude, longitude, la, lo) with km on the WGS84 ellipsoid, a table a round."""
    f = "(1/298.257223563::double)"
    first = f"""gd0 as (select *, sin(u1) as s1, cos(u1) as c1, sin(u2) as s2, cos(u2) as c2, l as t0 from (select *, radians((longitude-lo+540)-360*floor((longitude-lo+540)/360)-180) as l,
  atan((1-{f})*tan(radians(la))) as u1, atan((1-{f})*tan(radians(latitude))) as u2 from {source} where la is not null))"""
    sides = "(c2*sin(t{0}))**2+(c1*s2-s1*c2*cos(t{0}))**2"
    tables = [first]
    for i in range(rounds):
        tables.append(f"""gd{i + 1} as (select * exclude (t{i}, ss, cs, sa, up, mid, c), l+(1-c)*{f}*sa*(atan2(ss, cs)+c*ss*(mid+c*cs*(2*mid**2-1))) as t{i + 1}, t{i} as before_ from
  (select *, {f}/16*up*(4+{f}*(4-3*up)) as c from (select *, case when up>1e-14 then cs-2*s1*s2/up else 0 end as mid from (select *, 1-sa**2 as up from
  (select *, case when ss>0 then c1*c2*sin(t{i})/ss else 0 end as sa from (select * {"exclude (before_)" if i else ""}, sqrt({sides.format(i)}) as ss, s1*s2+c1*c2*cos(t{i}) as cs from gd{i}))))))""")
    t = f"t{rounds}"
    tables.append(f"""gd_end as (select *, case when abs({t}-before_)<=1e-12 and abs({t})<=pi() then 6378.137*(1-{f})*(1+v/16384*(4096+v*(v*(320-175*v)-768)))*(sg-q*ss*(mid+q/4*(cs*(2*mid**2-1)-q/6*mid*(4*ss**2-3)*(4*mid**2-3)))) end as km from
  (select *, v/1024*(256+v*(v*(74-47*v)-128)) as q from (select *, up*(1/(1-{f})**2-1) as v, atan2(ss, cs) as sg, case when up>1e-14 then cs-2*s1*s2/up else 0 end as mid from
  (select *, 1-(case when ss>0 then c1*c2*sin({t})/ss else 0 end)**2 as up from (select *, sqrt({sides.format(rounds)}) as ss, s1*s2+c1*c2*cos({t}) as cs from gd{rounds})))))""")
    return tables


def nearest(source: str, key: str, lat: str, lon: str, name: str, radius: int = 500) -> str:
    d = distance("q.", "p.")
    return f"""
{name} as (select {key}, arg_min(portcode, (km_, pos)) as portcode, min(km_) as port_km from
  (select {", ".join("q." + k for k in key.split(", "))}, p.pos, p.portcode, {d} as km_ from (select {key}, {lat} as latitude, {lon} as longitude from {source}) q join ports p on {d}<={radius}) group by {key})"""


NAMED = f"""
kept as (select * from summary where km>=50 and n_points>=3),
{nearest("kept", "mmsi, voyage_id", "first_latitude", "first_longitude", "np1")},
{nearest("kept", "mmsi, voyage_id", "last_latitude", "last_longitude", "np2")},
named as (select k.*, a.portcode as origin, b.portcode as destination from kept k join np1 a on k.mmsi=a.mmsi and k.voyage_id=a.voyage_id join np2 b on k.mmsi=b.mmsi and k.voyage_id=b.voyage_id)"""
TRACKS = """
tracks as (select n.track_id, n.seq, n.latitude, n.longitude, a.portcode as origin, b.portcode as destination
  from (select mmsi as track_id, row_number() over (partition by mmsi order by dt_pos_utc, event_id) as seq, latitude, longitude from positions) n
  join ports a on n.track_id%10=a.pos join ports b on (n.track_id+3)%10=b.pos),
requests as (select mmsi as request_id, case when mmsi%11=0 then null when mmsi%7=0 then '' else a.portcode end as origin, b.portcode as destination, n.latitude, n.longitude
  from (select mmsi, arg_max(latitude, (dt_pos_utc, event_id)) as latitude, arg_max(longitude, (dt_pos_utc, event_id)) as longitude from positions group by mmsi) n
  join ports a on mmsi%10=a.pos join ports b on (mmsi+3)%10=b.pos)"""


def query(tables: list[str], body: str) -> str:
    return "with " + ", ".join(t.strip() for t in tables) + "\n" + body


POS = [PORTS, POSITIONS]
TEXTS = [*POS, CLEANED]
VOY = [*POS, VOYAGES, SLICES, SUMMARY]
WINDOWED = """newest as (select * from (select *, time_bucket(interval 30 minutes, dt_pos_utc) as window_start,
  row_number() over (partition by mmsi, time_bucket(interval 30 minutes, dt_pos_utc) order by dt_pos_utc desc, event_id desc) as r from positions) where r=1)"""
HISTORY = """
hist as (select *, row_number() over w as n_, lag(dest_code) over w as prev_, (row_number() over w>1 and dest_code is distinct from lag(dest_code) over w) as ch_ from snapshots where imo is not null window w as (partition by imo order by snapshot_ts, o_orderkey)),
hrun as (select *, sum(ch_::int) over (partition by imo order by snapshot_ts, o_orderkey rows unbounded preceding) as run_ from hist),
hdept as (select h.*, f.prev_ as dept_code from hrun h left join (select imo, run_, prev_ from hrun where ch_) f on h.imo=f.imo and h.run_=f.run_)"""

#: Every cleaned row with the code of its text, how it was found and its place among the rows of its ship.
CODED = """
coded as (select c.*, coalesce(r.portcode, l.code) as code0, case when r.portcode is not null then 'registered' else l.resolution end as resolution,
    case when r.portcode is null then l.confidence end as percent, case when r.portcode is not null then c.event_id when l.resolution is not null then c.event_id+1000000000 end as key_
  from cleaned c left join (select clean_dest, max(portcode) as portcode from registered group by clean_dest) r on c.clean_dest=r.clean_dest and length(c.clean_dest)>=3
  left join ladder l on c.clean_dest=l.clean_dest and length(c.clean_dest)>=3 and r.portcode is null)"""
LAST_CODE = "arg_max(code0, key_) filter (key_ is not null) over (partition by mmsi)"
DAY = """
day as (select * from positions where strftime(dt_pos_utc, '%Y%m%d')=(select max(strftime(dt_pos_utc, '%Y%m%d')) from positions)),
listed as (select * from day where imo in (select imo from watch_list))"""

SQL: dict[str, str] = {
    "clean_destination": query(TEXTS, "select event_id, destination, clean_dest, coalesce(length(clean_dest)>=3, false) as valid from cleaned"),
    "valid_split_counts": query(TEXTS, "select count(*) as n_rows, count(*) filter (coalesce(length(clean_dest)>=3, false)) as n_valid, count(*) filter (not coalesce(length(clean_dest)>=3, false)) as n_invalid from cleaned"),
    "noise_flags": query(TEXTS, f"select clean_dest, {noise_full('clean_dest')} as is_noise, case when not {noise_full('clean_dest')} then {noise_part('clean_dest')} end as has_noise from (select distinct clean_dest from cleaned where clean_dest is not null)"),
    "last_word_candidates": query(TEXTS, f"select clean_dest, string_split(trim(clean_dest), ' ')[-1] as last_word, array_to_string({candidates('trim(clean_dest)')}, '|') as candidates from (select distinct clean_dest from cleaned where clean_dest is not null)"),
    "numeric_text": query(TEXTS, f"select clean_dest, {numeric('clean_dest')} as is_numeric from (select distinct clean_dest from cleaned where clean_dest is not null)"),
    "match_code": query([*TEXTS, MATCHED], "select clean_dest, code as matched_code from matched"),
    "match_name": query(
        TEXTS,
        f"""select t.clean_dest, b.pos, b.portcode from (select distinct clean_dest from cleaned where clean_dest is not null) t left join
 (select * from (select c.clean_dest, p.pos, p.portcode, row_number() over (partition by c.clean_dest order by try_, p.pos) as r
   from (select clean_dest, unnest(range(1, len(c)+1)) as try_, upper(unnest(c)) as word from (select clean_dest, {candidates("trim(clean_dest)")} as c from (select distinct clean_dest from cleaned where clean_dest is not null))) c
   join ports p on (length(word)=5 and word=p.portcode) or (length(word)=2 and word=p.country_code) or (length(word)=3 and word=p.city_code)
     or (length(word)>=4 and length(word)<>5 and (contains(upper(p.country_name), word) or contains(upper(p.city_name), word)))) where r=1) b on t.clean_dest=b.clean_dest""",
    ),
    "registered_lookup": query([*TEXTS, REGISTERED], "select event_id, c.clean_dest, r.portcode as registered_code from cleaned c left join (select clean_dest, max(portcode) as portcode from registered group by clean_dest) r on c.clean_dest=r.clean_dest"),
    "ngram_scores": query([*TEXTS, SCORES], "select clean_dest, code, confidence from scores"),
    "hybrid_code": query([*TEXTS, SCORES, LADDER], "select clean_dest, pred, confidence, code, resolution from ladder"),
    "code_batch": query([*TEXTS, "cleaned0 as (select event_id, coalesce(clean_dest, '') as clean_dest from cleaned)", SCORES.replace("from cleaned where", "from cleaned0 where"), LADDER], "select event_id, c.clean_dest, code, resolution from cleaned0 c join ladder l on c.clean_dest=l.clean_dest"),
    "country_groups": query([*TEXTS, MATCHED], f"select coalesce({group_of('code')}, 'none') as country_group, count(*) as n_positions from cleaned c join matched m on c.clean_dest=m.clean_dest where length(c.clean_dest)>=3 group by 1"),
    "with_country": query(
        [PORTS, SNAPSHOTS, RANKED, "countries as (select country_code, min(country_name) as country from ports group by country_code)"],
        "select imo, dest_code, coalesce(a.country, '') as dest_country, dept_code, coalesce(b.country, '') as dept_country from cur left join countries a on substr(dest_code,1,2)=a.country_code left join countries b on substr(dept_code,1,2)=b.country_code",
    ),
    "sanitised_port_codes": query([PORTS], "select pos, regexp_replace(portcode||'-'||city_name, '[^a-zA-Z0-9]', '', 'g') as code from ports"),
    "watch_list_filter": query([SNAPSHOTS, WATCH], "select o_orderkey, imo, dest_code from snapshots where imo in (select imo from watch_list)"),
    "latest_snapshot": query([*POS, "ids as (select *, 'lvi_prm_'||strftime(dt_pos_utc, '%Y%m%d%H')||case when minute(dt_pos_utc)<30 then '10' else '40' end||'00' as snapshot_id from positions)"], "select event_id, snapshot_id from ids where snapshot_id=(select max(snapshot_id) from ids where starts_with(snapshot_id, 'lvi_prm_2024'))"),
    "snapshot_catalogue": query([*POS, "ids as (select *, 'lvi_prm_'||strftime(dt_pos_utc, '%Y%m%d%H')||case when minute(dt_pos_utc)<30 then '10' else '40' end||'00' as snapshot_id from positions)"], "select snapshot_id as tb_name, '1' as tb_usage, min(dt_pos_utc) as tb_time, max(dt_pos_utc) as tb_endtime from ids group by snapshot_id"),
    "latest_per_vessel": query(POS, "select event_id, mmsi, dt_pos_utc, destination from (select *, row_number() over (partition by mmsi order by dt_pos_utc desc, event_id desc) as r from positions) where r=1"),
    "carry_departure": query([SNAPSHOTS, RANKED], "select c.imo, c.dest_code, case when p.imo is null then c.dept_code when c.dest_code is not distinct from p.dest_code then p.dept_code else p.dest_code end as dept_code, p.imo is not null and c.dest_code is distinct from p.dest_code as changed from cur c left join past p on c.imo=p.imo"),
    "changed_departures": query([SNAPSHOTS, RANKED], "select count(*) filter (p.imo is not null and c.dest_code is distinct from p.dest_code) as n_changed, count(*) as n_ships from cur c left join past p on c.imo=p.imo"),
    "departure_strict": query([SNAPSHOTS, RANKED], "select c.imo, c.dest_code, case when c.dest_code<>p.dest_code then p.dest_code else '' end as dept_code from cur c join past p on c.imo=p.imo where c.dest_code is not null and p.dest_code is not null"),
    "code_delta": query([SNAPSHOTS, RANKED], "select c.imo, coalesce(c.dest_code, '') as dest_code, coalesce(c.dept_code, '') as dept_code from cur c where c.imo in (select imo from past)"),
    "previous_destination": query(
        [SNAPSHOTS, RANKED],
        """select c.imo, c.dest_code as asked, (case when count(*) filter (s.dest_code is distinct from c.dest_code)>0
  then arg_max({'c': s.dest_code}, (s.snapshot_ts, s.o_orderkey)) filter (s.dest_code is distinct from c.dest_code) else arg_min({'c': s.dest_code}, (s.snapshot_ts, s.o_orderkey)) end).c as previous_code
from cur c join snapshots s on s.imo=c.imo group by c.imo, c.dest_code""",
    ),
    "departure_history": query([SNAPSHOTS, HISTORY], "select o_orderkey, imo, dest_code, dept_code from hdept union all select o_orderkey, imo, dest_code, null from snapshots where imo is null"),
    "update_from": query([SNAPSHOTS, RANKED], "select s.o_orderkey, s.imo, case when p.imo is not null then p.dest_code else s.dest_code end as dest_code from snapshots s left join past p on s.imo=p.imo"),
    "read_history": query(POS, "select event_id, mmsi, dt_pos_utc from positions where dt_pos_utc>=(select date_trunc('day', min(ts))+interval 1 day from events) and dt_pos_utc<=(select date_trunc('day', min(ts))+interval 41 day from events)"),
    "ship_history": query(POS, "select event_id, mmsi, dt_pos_utc from positions where dt_pos_utc<=(select date_trunc('day', min(ts))+interval 3 day from events) and mmsi=(select min(mmsi) from positions)"),
    "split_valid": query(TEXTS, "select event_id, coalesce(length(clean_dest)>=3, false) as valid from cleaned"),
    "normalise_history": query(POS, "select mmsi, imo, nav_status, longitude, case when event_id%5>0 then round(sog, 6) end as sog, destination from positions"),
    "snapshots_by_prefix": query(POS, "select event_id, 'lvi_prm_'||strftime(dt_pos_utc, '%Y%m%d') as snapshot_id from positions where strftime(dt_pos_utc, '%Y%m')='202401'"),
    "sort_history": query(POS, "select event_id, imo, dt_pos_utc from positions"),
    "fleet_extract": query([*POS, WATCH], "select event_id, mmsi, imo, nav_status, 'lvi_prm_'||strftime(dt_pos_utc, '%Y%m%d') as snapshot_id from positions where mmsi-191000000 in (select imo from watch_list) and year(dt_pos_utc)=2024"),
    "export_groups": query([*TEXTS, MATCHED], f"select event_id, code as dest_code, {group_of('code')} as country_group from cleaned c join matched m on c.clean_dest=m.clean_dest where {group_of('code')} is not null"),
    "table_sinks": query([SNAPSHOTS], "select o_orderkey, imo, dest_code from snapshots union all select o_orderkey, imo, dest_code from snapshots where imo is null"),
    "stream_update": query([SNAPSHOTS], "select o_orderkey, imo, dest_code from snapshots"),
    "voyage_records": query([*VOY, NAMED], "select n.mmsi, n.voyage_id, n.origin as origin_code, n.destination as destination_code, h.dt_pos_utc from named n join h8 h on n.mmsi=h.mmsi and n.voyage_id=h.voyage_id"),
    "missing_counts": query(POS, "select count(*) filter (imo is null) as n_missing_imo, count(*) filter (sog is null) as n_missing_sog, count(*) filter (destination is null) as n_missing_destination from positions"),
    "drop_missing_key": query(POS, "select event_id, mmsi, imo from positions where imo is not null and imo<>0"),
    "ambiguous_ids": query(POS, "select mmsi from positions group by mmsi having count(distinct imo)>1"),
    "nav_status_values": query(POS, "select nav_status, count(*) as n_rows from positions group by nav_status"),
    "months_between": query(POS, "select mmsi, array_to_string(list_transform(range(date_trunc('month', min(dt_pos_utc)), date_trunc('month', max(dt_pos_utc)+interval 70 day)+interval 1 day, interval 1 month), lambda d: strftime(d, '%Y%m')), ',') as months from positions group by mmsi"),
    "fill_speed": query([*POS, VOYAGES], "select event_id, round(sog, 6) as sog from h2"),
    "with_steps": query(POS, "select event_id, case when la is not null then round(2*6371.0088*asin(sqrt(least(1.0, sin(radians(latitude-la)/2)**2+cos(radians(la))*cos(radians(latitude))*sin(radians(longitude-lo)/2)**2))), 3) end as step_km, round(epoch_us(dt_pos_utc-lt)/3.6e9, 6) as step_hours from (select *, lag(latitude) over w as la, lag(longitude) over w as lo, lag(dt_pos_utc) over w as lt from positions window w as (partition by mmsi order by dt_pos_utc, event_id))"),
    "geodesic_steps": query(
        [*POS, "lagged as (select event_id, latitude, longitude, lag(latitude) over w as la, lag(longitude) over w as lo from positions window w as (partition by mmsi order by dt_pos_utc, event_id))", *geodesics("lagged")],
        "select l.event_id, round(g.km, 4) as km from lagged l left join gd_end g on l.event_id=g.event_id",
    ),
    "nearest_port": query([*POS, nearest("positions", "event_id", "latitude", "longitude", "n")], "select event_id, portcode, round(port_km, 3) as port_km from n"),
    "cut_voyages": query([*POS, VOYAGES], "select event_id, mmsi, cut, voyage_id from h5"),
    "voyage_slices": query([*POS, VOYAGES, SLICES], "select event_id, mmsi, voyage_id from h7"),
    "drop_position_errors": query([*POS, VOYAGES, SLICES], "select event_id, mmsi, voyage_id from h8"),
    "voyage_summary": query(VOY, "select mmsi, voyage_id, n_points, round(km, 3) as km, started, ended, first_latitude, first_longitude, last_latitude, last_longitude from summary"),
    "voyages_od": query([*VOY, NAMED], "select mmsi, voyage_id, origin, destination, n_points from named"),
    "recent_origins": query([*VOY, NAMED], "select mmsi, rank, portCode, arrival_date from (select mmsi, row_number() over (partition by mmsi order by started desc, voyage_id desc) as rank, origin as portCode, strftime(started, '%Y-%m-%d') as arrival_date from named) where rank<=5"),
    "od_pairs": query([*VOY, NAMED], "select mmsi, row_number() over (partition by mmsi order by started, voyage_id)-1 as ordinal, origin, destination from named"),
    "ocean_side": query(POS, "select event_id, case when abs(d)<360-abs(d) then 'atlantic' else 'pacific' end as side from (select event_id, longitude-lag(longitude) over (partition by mmsi order by dt_pos_utc, event_id) as d from positions) where d is not null"),
    "port_position": query([*POS, TRACKS], "select request_id, r.destination, p.latitude as dest_latitude, p.longitude as dest_longitude from requests r left join ports p on r.destination=p.portcode"),
    "every_nth": query([*POS, TRACKS], "select track_id, seq from (select *, row_number() over (partition by track_id order by seq)-1 as nth from tracks) where nth%4=0"),
    "similar_tracks": query(
        [*POS, TRACKS],
        f"""select b.request_id, t.track_id, b.rank, t.seq, t.latitude, t.longitude from
 (select *, row_number() over (partition by request_id order by km, track_id) as rank from
   (select request_id, origin, destination, track_id, min(km) as km, arg_min(seq, (km, seq)) as from_ from
     (select r.request_id, t.origin, t.destination, t.track_id, t.seq, {distance("r.", "t.")} as km from requests r join tracks t on r.origin=t.origin and r.destination=t.destination) group by all)) b
 join tracks t on t.track_id=b.track_id and t.origin=b.origin and t.destination=b.destination and t.seq>=b.from_ where b.rank<=3""",
    ),
    "track_or_fallback": query([*POS, TRACKS], "select request_id, (origin is null or trim(origin)='' or not exists (select 1 from tracks t where t.origin=r.origin and t.destination=r.destination)) as needs_fallback from requests r"),
    "wkt_points": query(POS, "select event_id, 'POINT('||cast(longitude as varchar)||' '||cast(latitude as varchar)||')' as geom from positions"),
    "union_snapshots": query([*POS, SNAPSHOTS], "select event_id as row_id, imo, destination, null as dest_code from positions union all select o_orderkey, imo, null, dest_code from snapshots"),
    "snapshot_schema": query(POS, "select mmsi, cast(imo as int) as imo, destination, sog, strftime(dt_pos_utc, '%Y-%m-%d %H:%M:%S') as dt_pos_utc, vessel_name from (select *, null::varchar as vessel_name from positions)"),
    "stream_snapshots": query([*POS, WINDOWED], "select window_start, mmsi, event_id, destination from newest where window_start+interval 30 minutes<=(select max(dt_pos_utc) from positions)-interval 30 minutes"),
    "stream_code": query([*TEXTS, REGISTERED, SCORES, LADDER, CODED], "select event_id, clean_dest, code0 as code, resolution from coded where resolution is not null"),
    "coding_report": query([*TEXTS, REGISTERED, SCORES, LADDER, CODED], f"select mmsi, destination as input, clean_dest as destination, {LAST_CODE} as port_code, percent, resolution from coded where resolution is not null"),
    "points_by_month": query([*POS, VOYAGES, SLICES], "select event_id, mmsi, voyage_id from h8"),
    "voyages_by_month": query([*VOY, NAMED], "select mmsi, voyage_id, origin, destination, n_points, round(km, 3) as km, started, ended from named"),
    "keyed_update": query([SNAPSHOTS, RANKED], "select s.o_orderkey, s.imo, case when p.imo is not null then p.dest_code else s.dest_code end as dest_code, strftime(s.snapshot_ts, '%Y%m') as month from snapshots s left join past p on s.imo=p.imo"),
    "stream_upsert": query([SNAPSHOTS, RANKED], "select imo, dest_code from cur"),
    "port_dictionary": query([PORTS], "select pos, portcode, country_code, city_code, country_name, city_name from ports"),
    "read_watch_list": query([WATCH], "select distinct imo from watch_list"),
    "carry_etd": query(
        [SNAPSHOTS, RANKED],
        """select c.imo, c.dest_code, case when p.imo is null then c.dept_code when c.dest_code is not distinct from p.dest_code then p.dept_code else p.dest_code end as dept_code,
 case when p.imo is not null and c.dest_code is distinct from p.dest_code then 'eta '||p.o_orderkey else 'own' end as etd, p.imo is not null and c.dest_code is distinct from p.dest_code as changed from cur c left join past p on c.imo=p.imo""",
    ),
    "plugin_scorer": query(TEXTS, f"select clean_dest, case when length(trim(clean_dest))<=2 or {numeric('clean_dest')} then '' else upper(substr(clean_dest, 1, 5)) end as pred, round(least(length(clean_dest), 30)/30.0::double*100, 2) as confidence from (select distinct clean_dest from cleaned where clean_dest is not null)"),
    "coding_csv": query(
        [*POS, SNAPSHOTS, RANKED, WATCH, DAY, clean("listed", "destination", "cleaned"), REGISTERED, SCORES, LADDER, CODED],
        f"""select c.event_id, c.imo, c.destination, c.dest_code, case when p.imo is null then null when c.dest_code is not distinct from p.dest_code then p.dept_code else p.dest_code end as dept_code, resolution
    from (select *, case when resolution is not null then {LAST_CODE} end as dest_code from coded) c left join past p on c.imo=p.imo and c.imo<>0""",
    ),
    "coding_cycle": query(
        [*POS, SNAPSHOTS, RANKED, WATCH, DAY, clean("listed", "destination", "cleaned"), REGISTERED, SCORES, LADDER, CODED],
        f"""select day.event_id, day.imo, u.x.d as dest_code, u.x.p as dept_code from day left join (select imo, arg_max({{'d': dest_code, 'p': dept_code}}, event_id) as x from
 (select c.event_id, c.imo, c.dest_code, case when p.imo is null then null when c.dest_code is not distinct from p.dest_code then p.dept_code else p.dest_code end as dept_code
    from (select *, case when resolution is not null then {LAST_CODE} end as dest_code from coded) c left join past p on c.imo=p.imo and c.imo<>0) where imo is not null group by imo) u on day.imo=u.imo""",
    ),
    "code_destinations": query([*TEXTS, REGISTERED, SCORES, LADDER, CODED], f"select event_id, mmsi, clean_dest, case when resolution is not null then {LAST_CODE} end as dest_code, resolution from coded"),
}
SQL["previous_destination_back"] = SQL["previous_destination"]
SQL["stream_departures"] = SQL["departure_history"]
