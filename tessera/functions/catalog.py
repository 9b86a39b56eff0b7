"""Functions as data: name = Spark SQL with {0}, {1}, … for arguments and {*} for all of them.

Names that aren't here are the same in Spark. UNSUPPORTED names have no Spark counterpart. Classes
(aggregate, window, generator, table) drive lineage and lint.
"""

from __future__ import annotations

_ONE_LINE = r"""
add=({0} + {1}); subtract=({0} - {1}); multiply=({0} * {1}); divide=({0} div {1}); fdiv=floor({0} / {1}); fmod=({0} - {1} * floor({0} / {1}))
any_value=any_value({0}, true); arbitrary=first({0}); first=first({0}); last=last({0}); arg_max=max_by({0}, {1}); arg_max_null=max_by({0}, {1}); argmax=max_by({0}, {1}); arg_min=min_by({0}, {1}); arg_min_null=min_by({0}, {1}); argmin=min_by({0}, {1})
approx_quantile=percentile_approx({0}, {1}); approx_top_k=transform(approx_top_k({0}, {1}), r -> r.item); reservoir_quantile=percentile_approx({0}, {1}); mean=avg({0}); favg=avg({0}); fsum=sum({0}); kahan_sum=sum({0}); sumkahan=sum({0}); sum_no_overflow=sum({0}); count_star=count(*)
array_agg=transform(collect_list(struct({0} AS x)), r -> r.x); list=transform(collect_list(struct({0} AS x)), r -> r.x)
quantile=percentile_disc({1}) WITHIN GROUP (ORDER BY {0}); quantile_disc=percentile_disc({1}) WITHIN GROUP (ORDER BY {0}); quantile_cont=percentile_cont({1}) WITHIN GROUP (ORDER BY {0})
geomean=exp(avg(ln({0}))); geometric_mean=exp(avg(ln({0}))); product=aggregate(collect_list(CAST({0} AS DOUBLE)), 1D, (a, b) -> a * b); sem=(stddev_pop({0}) / sqrt(count({0})))
kurtosis=(((count({0}) - 1D) / ((count({0}) - 2D) * (count({0}) - 3D))) * ((count({0}) + 1D) * kurtosis({0}) + 6D)); kurtosis_pop=kurtosis({0}); skewness=(skewness({0}) * sqrt(count({0}) * (count({0}) - 1D)) / (count({0}) - 2D))
mad=median(abs({0} - median({0}))); bitstring_agg=UNSUPPORTED; json_group_array=to_json(collect_list({0})); json_group_object=to_json(map_from_entries(collect_list(struct({0}, {1}))))
entropy=UNSUPPORTED; histogram=UNSUPPORTED; histogram_exact=UNSUPPORTED; json_group_structure=UNSUPPORTED
apply=transform({0}, {1}); array_apply=transform({0}, {1}); array_transform=transform({0}, {1}); list_apply=transform({0}, {1}); list_transform=transform({0}, {1}); array_filter=filter({0}, {1}); list_filter=filter({0}, {1})
array_cat=concat({0}, {1}); array_concat=concat({0}, {1}); list_cat=concat({0}, {1}); list_concat=concat({*}); array_extract=try_element_at({0}, {1}); list_element=try_element_at({0}, {1}); list_extract=try_element_at({0}, {1})
array_has=array_contains({0}, {1}); list_has=array_contains({0}, {1}); list_contains=array_contains({0}, {1}); array_has_all=(size(array_except({1}, {0})) = 0); list_has_all=(size(array_except({1}, {0})) = 0); array_has_any=arrays_overlap({0}, {1}); list_has_any=arrays_overlap({0}, {1})
array_indexof=nullif(array_position({0}, {1}), 0); list_indexof=nullif(array_position({0}, {1}), 0); array_position=nullif(array_position({0}, {1}), 0); list_position=nullif(array_position({0}, {1}), 0)
array_length=size({0}); list_count=size(filter({0}, x -> x IS NOT NULL)); array_pop_back=slice({0}, 1, size({0}) - 1); array_pop_front=slice({0}, 2, size({0}) - 1); array_push_back=array_append({0}, {1}); array_push_front=array_prepend({0}, {1}); list_append=array_append({0}, {1}); list_prepend=array_prepend({1}, {0})
array_distinct=array_distinct(filter({0}, x -> x IS NOT NULL)); list_distinct=array_distinct(filter({0}, x -> x IS NOT NULL)); array_unique=size(array_distinct(filter({0}, x -> x IS NOT NULL))); list_unique=size(array_distinct(filter({0}, x -> x IS NOT NULL)))
array_reverse=reverse({0}); list_reverse=reverse({0}); array_reverse_sort=sort_array({0}, false); list_reverse_sort=sort_array({0}, false); list_sort=sort_array({0}); array_sort=sort_array({0})
array_slice=slice({0}, {1}, greatest({2} - {1} + 1, 0)); list_slice=slice({0}, {1}, greatest({2} - {1} + 1, 0)); array_resize=slice(concat({0}, array_repeat({2}, {1})), 1, {1}); list_resize=slice(concat({0}, array_repeat({2}, {1})), 1, {1})
array_select=transform({1}, i -> try_element_at({0}, CAST(i AS INT))); list_select=transform({1}, i -> try_element_at({0}, CAST(i AS INT))); array_where=filter({0}, (x, i) -> get({1}, i)); list_where=filter({0}, (x, i) -> get({1}, i)); array_zip=arrays_zip({*}); list_zip=arrays_zip({*})
array_grade_up=transform(array_sort(arrays_zip({0}, sequence(1, size({0})))), s -> s.`1`); list_grade_up=transform(array_sort(arrays_zip({0}, sequence(1, size({0})))), s -> s.`1`); grade_up=transform(array_sort(arrays_zip({0}, sequence(1, size({0})))), s -> s.`1`)
array_to_string=array_join({0}, {1}); list_string_agg=array_join({0}, ','); array_to_string_comma_default=array_join({0}, ','); array_to_json=to_json({0}); array_value=array({*}); list_value=array({*}); list_pack=array({*}); array_intersect=array_intersect({0}, {1}); list_intersect=array_intersect({0}, {1})
array_reduce=aggregate(slice({0}, 2, size({0}) - 1), get({0}, 0), {1}); list_reduce=aggregate(slice({0}, 2, size({0}) - 1), get({0}, 0), {1}); reduce=aggregate(slice({0}, 2, size({0}) - 1), get({0}, 0), {1})
list_any_value=get(filter({0}, x -> x IS NOT NULL), 0); list_first=get({0}, 0); list_last=try_element_at({0}, -1); list_max=array_max({0}); list_min=array_min({0}); list_bool_and=forall({0}, x -> x); list_bool_or=exists({0}, x -> x); list_approx_count_distinct=size(array_distinct({0}))
list_sum=aggregate(filter({0}, x -> x IS NOT NULL), CAST(0 AS DOUBLE), (s, x) -> s + x); list_avg=(aggregate(filter({0}, x -> x IS NOT NULL), CAST(0 AS DOUBLE), (s, x) -> s + x) / size(filter({0}, x -> x IS NOT NULL))); list_product=aggregate({0}, 1D, (s, x) -> s * x)
list_bit_and=aggregate({0}, -1L, (s, x) -> s & x); list_bit_or=aggregate({0}, 0L, (s, x) -> s | x); list_bit_xor=aggregate({0}, 0L, (s, x) -> s ^ x)
list_var_pop=get(transform(transform(array(filter({0}, x -> x IS NOT NULL)), v -> struct(v AS v, aggregate(v, 0D, (s, x) -> s + x) / nullif(size(v), 0) AS m)), r -> aggregate(r.v, 0D, (s, x) -> s + pow(x - r.m, 2)) / nullif(size(r.v), 0)), 0); list_stddev_pop=sqrt(get(transform(transform(array(filter({0}, x -> x IS NOT NULL)), v -> struct(v AS v, aggregate(v, 0D, (s, x) -> s + x) / nullif(size(v), 0) AS m)), r -> aggregate(r.v, 0D, (s, x) -> s + pow(x - r.m, 2)) / nullif(size(r.v), 0)), 0))
list_median=((get(sort_array(CAST({0} AS ARRAY<DOUBLE>)), (size({0}) - 1) div 2) + get(sort_array(CAST({0} AS ARRAY<DOUBLE>)), size({0}) div 2)) / 2)
array_dot_product=aggregate(zip_with({0}, {1}, (x, y) -> CAST(x * y AS DOUBLE)), 0D, (s, x) -> s + x); array_inner_product=aggregate(zip_with({0}, {1}, (x, y) -> CAST(x * y AS DOUBLE)), 0D, (s, x) -> s + x); list_dot_product=aggregate(zip_with({0}, {1}, (x, y) -> CAST(x * y AS DOUBLE)), 0D, (s, x) -> s + x); list_inner_product=aggregate(zip_with({0}, {1}, (x, y) -> CAST(x * y AS DOUBLE)), 0D, (s, x) -> s + x)
array_negative_dot_product=-aggregate(zip_with({0}, {1}, (x, y) -> CAST(x * y AS DOUBLE)), 0D, (s, x) -> s + x); array_negative_inner_product=-aggregate(zip_with({0}, {1}, (x, y) -> CAST(x * y AS DOUBLE)), 0D, (s, x) -> s + x); list_negative_dot_product=-aggregate(zip_with({0}, {1}, (x, y) -> CAST(x * y AS DOUBLE)), 0D, (s, x) -> s + x); list_negative_inner_product=-aggregate(zip_with({0}, {1}, (x, y) -> CAST(x * y AS DOUBLE)), 0D, (s, x) -> s + x)
array_distance=sqrt(aggregate(zip_with({0}, {1}, (x, y) -> pow(x - y, 2)), 0D, (s, x) -> s + x)); list_distance=sqrt(aggregate(zip_with({0}, {1}, (x, y) -> pow(x - y, 2)), 0D, (s, x) -> s + x))
list_cosine_similarity=(aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, x) -> s + x) / sqrt(aggregate({0}, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x) * aggregate({1}, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x))); array_cosine_similarity=(aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, x) -> s + x) / sqrt(aggregate({0}, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x) * aggregate({1}, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x)))
list_cosine_distance=(1 - aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, x) -> s + x) / sqrt(aggregate({0}, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x) * aggregate({1}, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x))); array_cosine_distance=(1 - aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, x) -> s + x) / sqrt(aggregate({0}, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x) * aggregate({1}, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x)))
array_cross_product=array(get({0}, 1) * get({1}, 2) - get({0}, 2) * get({1}, 1), get({0}, 2) * get({1}, 0) - get({0}, 0) * get({1}, 2), get({0}, 0) * get({1}, 1) - get({0}, 1) * get({1}, 0))
chr=decode(unhex(lpad(hex({0}), 8, '0')), 'UTF-32'); bar=rpad(concat(repeat('█', CAST(floor(greatest(least(({0} - {1}) / CAST({2} - {1} AS DOUBLE), 1D), 0D) * {3} * 8) AS INT) div 8), coalesce(try_element_at(array('▏', '▎', '▍', '▌', '▋', '▊', '▉'), nullif(CAST(floor(greatest(least(({0} - {1}) / CAST({2} - {1} AS DOUBLE), 1D), 0D) * {3} * 8) AS INT) % 8, 0)), '')), CAST({3} AS INT), ' '); contains=contains({0}, {1}); ends_with=endswith({0}, {1}); suffix=endswith({0}, {1}); starts_with=startswith({0}, {1}); prefix=startswith({0}, {1}); concat=concat_ws('', {*})
editdist3=levenshtein({0}, {1}); hamming=aggregate(zip_with(split({0}, ''), split({1}, ''), (x, y) -> IF(x = y, 0, 1)), 0, (s, x) -> s + x); mismatches=aggregate(zip_with(split({0}, ''), split({1}, ''), (x, y) -> IF(x = y, 0, 1)), 0, (s, x) -> s + x)
encode=encode({0}, 'UTF-8'); decode=decode({0}, 'UTF-8'); from_base64=unbase64({0}); to_base64=base64({0}); from_hex=unhex({0}); to_hex=hex({0}); sha256=sha2({0}, 256); to_base=conv(CAST({0} AS STRING), 10, {1}); bin=bin({0}); to_binary=bin({0}); unbin=unhex(conv({0}, 2, 16)); from_binary=unhex(conv({0}, 2, 16))
group_concat=listagg({0}, ','); len=length({0}); strlen=octet_length({0}); strpos=instr({0}, {1}); instr=instr({0}, {1}); position=instr({0}, {1}); ord=ascii({0}); unicode=ascii({0}); left_grapheme=array_join(slice(regexp_extract_all({0}, r'\X', 0), 1, IF({1} >= 0, {1}, greatest(size(regexp_extract_all({0}, r'\X', 0)) + {1}, 0))), ''); right_grapheme=array_join(slice(regexp_extract_all({0}, r'\X', 0), greatest(size(regexp_extract_all({0}, r'\X', 0)) - IF({1} >= 0, {1}, greatest(size(regexp_extract_all({0}, r'\X', 0)) + {1}, 0)), 0) + 1, size(regexp_extract_all({0}, r'\X', 0))), ''); length_grapheme=size(regexp_extract_all({0}, r'\X', 0)); substring_grapheme=array_join(slice(regexp_extract_all({0}, r'\X', 0), {1}, {2}), '')
parse_filename=element_at(split({0}, '/'), -1); parse_path=split({0}, '/'); parse_dirname=split_part({0}, '/', 1); parse_dirpath=regexp_extract({0}, '^(.*)/[^/]*$', 1); like_escape=({0} LIKE {1} ESCAPE {2}); ilike_escape=({0} ILIKE {1} ESCAPE {2}); not_like_escape=(NOT ({0} LIKE {1} ESCAPE {2})); not_ilike_escape=(NOT ({0} ILIKE {1} ESCAPE {2}))
regexp_matches=({0} RLIKE {1}); regexp_full_match=({0} RLIKE concat('^(?:', {1}, ')$')); regexp_split_to_array=split({0}, {1}); string_split_regex=split({0}, {1}); str_split_regex=split({0}, {1}); regexp_escape=regexp_replace({0}, '([^A-Za-z0-9_])', r'\\$1')
split=split({0}, concat(r'\Q', {1}, r'\E')); str_split=split({0}, concat(r'\Q', {1}, r'\E')); string_split=split({0}, concat(r'\Q', {1}, r'\E')); string_to_array=split({0}, concat(r'\Q', {1}, r'\E')); md5_number=UNSUPPORTED; md5_number_lower=UNSUPPORTED; md5_number_upper=UNSUPPORTED
strip_accents=tessera_strip_accents({0}); nfc_normalize=tessera_nfc({0}); jaccard=(size(array_intersect(split({0}, ''), split({1}, ''))) / CAST(size(array_union(split({0}, ''), split({1}, ''))) AS DOUBLE)); jaro_similarity=tessera_jaro({0}, {1}); jaro_winkler_similarity=tessera_jaro_winkler({0}, {1}); damerau_levenshtein=tessera_damerau({0}, {1})
century=CAST(ceil(year({0}) / 100) AS BIGINT); millennium=CAST(ceil(year({0}) / 1000) AS BIGINT); decade=(year({0}) div 10); dayname=date_format({0}, 'EEEE'); monthname=date_format({0}, 'MMMM'); dayofweek=(dayofweek({0}) - 1); weekday=(dayofweek({0}) - 1); isodow=extract(DAYOFWEEK_ISO FROM {0}); isoyear=extract(YEAROFWEEK FROM {0}); era=CASE WHEN year({0}) > 0 THEN 1 ELSE 0 END; week=weekofyear({0}); yearweek=(extract(YEAROFWEEK FROM {0}) * 100 + weekofyear({0}))
epoch=(unix_micros(CAST({0} AS TIMESTAMP)) / 1000000D); epoch_ms=((unix_micros(CAST({0} AS TIMESTAMP)) + IF(unix_micros(CAST({0} AS TIMESTAMP)) < 0, -500, 500)) div 1000); epoch_us=unix_micros(CAST({0} AS TIMESTAMP)); epoch_ns=(unix_micros(CAST({0} AS TIMESTAMP)) * 1000); julian=(datediff({0}, DATE'1970-01-01') + 2440588); microsecond=CAST(extract(SECOND FROM {0}) * 1000000 AS BIGINT); millisecond=CAST(extract(SECOND FROM {0}) * 1000 AS BIGINT); nanosecond=CAST(extract(SECOND FROM {0}) * 1000000000 AS BIGINT)
datetrunc=date_trunc({0}, {1}); date_trunc=date_trunc({0}, {1}); today=current_date(); get_current_timestamp=current_timestamp(); get_current_time=current_time(); transaction_timestamp=current_timestamp(); to_timestamp=timestamp_seconds({0}); strptime=to_timestamp_ntz({0}, {1}); try_strptime=try_to_timestamp({0}, {1}); strftime=date_format({0}, {1}); timezone=from_utc_timestamp({1}, {0})
to_days=make_dt_interval(CAST({0} AS INT)); to_hours=make_dt_interval(0, CAST({0} AS INT)); to_minutes=make_dt_interval(0, 0, CAST({0} AS INT)); to_seconds=make_dt_interval(0, 0, 0, {0}); to_milliseconds=make_dt_interval(0, 0, 0, {0} / 1000); to_microseconds=make_dt_interval(0, 0, 0, {0} / 1000000); to_weeks=make_dt_interval(CAST({0} * 7 AS INT)); to_months=make_ym_interval(0, CAST({0} AS INT)); to_quarters=make_ym_interval(0, CAST({0} * 3 AS INT)); to_years=make_ym_interval(CAST({0} AS INT)); to_decades=make_ym_interval(CAST({0} * 10 AS INT)); to_centuries=make_ym_interval(CAST({0} * 100 AS INT)); to_millennia=make_ym_interval(CAST({0} * 1000 AS INT))
even=CAST(CASE WHEN {0} >= 0 THEN ceil({0} / 2) * 2 ELSE floor({0} / 2) * 2 END AS DOUBLE); isfinite=(NOT isnan({0}) AND abs({0}) < double('infinity')); isinf=(abs({0}) = double('infinity')); log=log10({0}); round_even=bround({0}, {1}); roundbankers=bround({0}, {1}); trunc=CAST(CAST({0} AS BIGINT) AS DOUBLE); signbit=({0} < 0 OR CAST({0} AS STRING) LIKE '-%'); xor=({0} ^ {1}); bit_position=UNSUPPORTED
gamma=tessera_gamma(CAST({0} AS DOUBLE)); lgamma=tessera_lgamma(CAST({0} AS DOUBLE)); gcd=aggregate(sequence(1, 93), struct(abs(CAST({0} AS BIGINT)) AS a, abs(CAST({1} AS BIGINT)) AS b), (s, i) -> IF(s.b = 0, s, struct(s.b AS a, s.a % s.b AS b)), s -> s.a); greatest_common_divisor=aggregate(sequence(1, 93), struct(abs(CAST({0} AS BIGINT)) AS a, abs(CAST({1} AS BIGINT)) AS b), (s, i) -> IF(s.b = 0, s, struct(s.b AS a, s.a % s.b AS b)), s -> s.a); lcm=IF({0} = 0 OR {1} = 0, 0L, abs(CAST({0} AS BIGINT) div aggregate(sequence(1, 93), struct(abs(CAST({0} AS BIGINT)) AS a, abs(CAST({1} AS BIGINT)) AS b), (s, i) -> IF(s.b = 0, s, struct(s.b AS a, s.a % s.b AS b)), s -> s.a) * {1})); least_common_multiple=IF({0} = 0 OR {1} = 0, 0L, abs(CAST({0} AS BIGINT) div aggregate(sequence(1, 93), struct(abs(CAST({0} AS BIGINT)) AS a, abs(CAST({1} AS BIGINT)) AS b), (s, i) -> IF(s.b = 0, s, struct(s.b AS a, s.a % s.b AS b)), s -> s.a) * {1})); nextafter=tessera_nextafter(CAST({0} AS DOUBLE), CAST({1} AS DOUBLE)); random=rand(); gen_random_uuid=uuid()
map=map_from_arrays({0}, {1}); map_contains=map_contains_key({0}, {1}); map_contains_entry=(map_contains_key({0}, {1}) AND try_element_at({0}, {1}) <=> {2}); map_contains_value=array_contains(map_values({0}), {1}); map_extract=filter(array(try_element_at({0}, {1})), x -> x IS NOT NULL); element_at=filter(array(try_element_at({0}, {1})), x -> x IS NOT NULL); cardinality=size({0})
json=to_json(parse_json({0})); json_array=to_json(array({*})); json_extract_string=get_json_object({0}, {1}); json_extract_path_text=get_json_object({0}, {1}); json_value=get_json_object({0}, {1}); json_extract=to_json(try_variant_get(parse_json({0}), {1}, 'variant')); json_extract_path=to_json(try_variant_get(parse_json({0}), {1}, 'variant')); json_exists=(try_variant_get(parse_json({0}), {1}, 'variant') IS NOT NULL); json_keys=json_object_keys({0}); json_quote=to_json({0}); json_structure=schema_of_json({0}); json_type=schema_of_variant(parse_json({0})); json_valid=(try_parse_json({0}) IS NOT NULL); json_transform=from_json({0}, {1}); from_json_strict=from_json({0}, {1}, map('mode', 'FAILFAST')); json_transform_strict=from_json({0}, {1}, map('mode', 'FAILFAST')); row_to_json=to_json({0}); json_merge_patch=tessera_json_merge({0}, {1}); json_pretty=tessera_json_pretty({0}); json_contains=tessera_json_contains({0}, {1})
row=struct({*}); error=raise_error({0}); generate_subscripts=sequence(1, size({0})); constant_or_null=IF({1} IS NULL, NULL, {0}); current_setting=UNSUPPORTED; currval=UNSUPPORTED; nextval=UNSUPPORTED; setseed=UNSUPPORTED; getvariable=UNSUPPORTED; enum_code=UNSUPPORTED; enum_first=UNSUPPORTED; enum_last=UNSUPPORTED; enum_range=UNSUPPORTED; enum_range_boundary=UNSUPPORTED; union_extract=UNSUPPORTED; union_tag=UNSUPPORTED; union_value=UNSUPPORTED; get_bit=getbit({0}, {1}); set_bit=UNSUPPORTED; bitstring=UNSUPPORTED
bool_and=bool_and({0}); bool_or=bool_or({0}); json_array_length=json_array_length({0}); generate_series=sequence({*}); isnan=isnan({0}); nullif=nullif({0}, {1}); ifnull=ifnull({0}, {1}); string_agg=listagg({0}, {1}); xmlagg=UNSUPPORTED; json_agg=to_json(collect_list({0})); jsonb_agg=to_json(collect_list({0})); cot=cot({0}); version=version()
"""
TEMPLATES: dict[str, str] = {}
for _line in _ONE_LINE.strip().splitlines():
    for _entry in _line.split("; "):
        _name, _, _text = _entry.partition("=")
        TEMPLATES[_name.strip()] = _text.strip()
UNSUPPORTED = frozenset(k for k, v in TEMPLATES.items() if v == "UNSUPPORTED")

AGGREGATES = frozenset("any_value approx_count_distinct approx_quantile approx_top_k arbitrary arg_max arg_max_null arg_min arg_min_null argmax argmin array_agg avg bit_and bit_or bit_xor bitstring_agg bool_and bool_or corr count count_if count_star covar_pop covar_samp entropy every favg first fsum geomean geometric_mean group_concat histogram histogram_exact kahan_sum kurtosis kurtosis_pop last list listagg mad max max_by mean median min min_by mode product quantile quantile_cont quantile_disc regr_avgx regr_avgy regr_count regr_intercept regr_r2 regr_slope regr_sxx regr_sxy regr_syy reservoir_quantile sem skewness stddev stddev_pop stddev_samp string_agg sum sum_no_overflow sumkahan var_pop var_samp variance json_agg jsonb_agg json_group_array json_group_object json_group_structure xmlagg collect_list collect_set percentile percentile_approx percentile_cont percentile_disc".split())
WINDOWS = frozenset("row_number rank dense_rank ntile percent_rank cume_dist lag lead first_value last_value nth_value".split())
GENERATORS = frozenset("random uuid gen_random_uuid now current_date current_time current_timestamp today pi current_user session_user user current_schema current_database current_catalog version localtime localtimestamp nextval currval get_current_time get_current_timestamp transaction_timestamp".split())
TABLES = frozenset("range generate_series unnest explode read_csv read_csv_auto read_json read_json_auto read_ndjson read_parquet parquet_scan read_text read_blob glob flatten posexplode inline stack json_tuple repeat_row query query_table summary regexp_split_to_table".split())
BARE = frozenset("current_date current_timestamp current_time current_user current_schema current_database current_catalog localtime localtimestamp".split())


def kind_of(name: str) -> str:
    """table, aggregate, generator, window or passthrough; in that order."""
    n = name.lower()
    for names, kind in ((TABLES, "table"), (AGGREGATES, "aggregate"), (GENERATORS, "generator"), (WINDOWS, "window")):
        if n in names:
            return kind
    return "passthrough"


_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "j": "DDD", "I": "hh", "p": "a", "f": "SSSSSS", "-d": "d", "-m": "M", "-H": "H", "g": "SSS", "%": "%", "z": "xx", "F": "yyyy-MM-dd", "T": "HH:mm:ss"}


def date_pattern(text: str) -> str:
    """A %-pattern as a pattern of letters."""
    out, i = [], 0
    while i < len(text):
        if text[i] == "%":
            key = text[i + 1 : i + 3] if text[i + 1 : i + 2] == "-" else text[i + 1 : i + 2]
            if key not in _STRFTIME:
                raise ValueError(f"no counterpart of the date pattern %{key}")
            out.append(_STRFTIME[key])
            i += 1 + len(key)
        else:
            out.append(f"'{text[i]}'" if text[i].isalpha() else text[i])
            i += 1
    return "".join(out)
