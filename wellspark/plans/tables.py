"""Columns of the domain tables, as the asset documents carry them.

Fixed values: the names and list types have to equal those of the source databases.
`name:type` gives the element type of a column that is folded into a list. A scalar keeps the type its
table has; its type here is for tables that lack the column.
"""

from __future__ import annotations

from pyspark.sql import types as T


WELL_HEADER = """
    gx_wsn:bigint uwi:string well_name:string well_number:string operator:string lease_name:string
    lease_number:string county:string province_state:string row_changed_date:timestamp
"""

WELL_COMPLETION = """
    base_depth:double base_form:string completion_date:timestamp completion_form:string
    completion_obs_no:bigint completion_type:string remark:string row_changed_date:timestamp
    source:string top_depth:double top_form:string uwi:string
"""

WELL_CORE = """
    base_depth:double base_depth_ouom:string core_id:string core_type:string
    gx_primary_core_form_alias:string gx_qualifying_field:string gx_remark:string gx_user1:string
    primary_core_form:string recovered_amt:double recovery_amt_ouom:string recovery_date:timestamp
    reported_core_number:string row_changed_date:timestamp source:string top_depth:double
    top_depth_ouom:string uwi:string
"""

WELL_CORE_SAMPLE_ANAL = """
    analysis_obs_no:bigint core_id:string gas_sat_vol:double grain_density:double
    grain_density_ouom:string gx_base_depth:double gx_bulk_density:double gx_formation:string
    gx_formation_alias:string gx_gamma_ray:double gx_lithology_desc:string gx_poissons_ratio:double
    gx_remark:string gx_resistivity:double gx_shift_depth:double gx_show_type:string gx_toc:double
    gx_total_clay:double gx_vitrinite_reflectance:double gx_youngs_modulus:double k90:double
    k90_ouom:string kmax:double kmax_ouom:string kvert:double kvert_ouom:string oil_sat:double
    pore_volume_oil_sat:double pore_volume_water_sat:double porosity:double
    row_changed_date:timestamp sample_id:string sample_number:bigint source:string top_depth:double
    top_depth_ouom:string uwi:string water_sat:double
"""

WELL_TEST = """
    base_depth:double base_form:string bottom_choke_desc:string casing_press:double
    choke_size_desc:string flow_press:double flow_temp:double gas_flow_amt:double
    gas_flow_amt_uom:string gor:double gx_base_form_alias:string gx_bhp_z:double gx_co2_pct:double
    gx_conversion_factor:double gx_cushion_type:string gx_cushion_vol:double
    gx_cushion_vol_ouom:string gx_ft_flow_amt:double gx_ft_flow_amt_uom:string gx_gas_cum:double
    gx_max_ft_flow_rate:double gx_max_ft_flow_rate_uom:string gx_recorder_depth:double
    gx_top_form_alias:string gx_tracer:string gx_z_factor:double h2s_pct:double
    max_gas_flow_rate:string max_hydrostatic_press:double max_oil_flow_rate:string
    max_water_flow_rate:string oil_flow_amt:double oil_flow_amt_uom:string oil_gravity:double
    primary_fluid_recovered:string production_method:string remark:string report_temp:double
    row_changed_date:timestamp shut_off_type:string test_date:timestamp test_duration:string
    test_number:string test_subtype:string top_choke_desc:string top_depth:double top_form:string
    water_flow_amt:double water_flow_amt_uom:string
"""

WELL_TEST_PRESSURE = """
    end_press:double gx_duration:string period_type:string row_changed_date:timestamp
    start_press:double test_number:bigint
"""

WELL_TEST_RECOVERY = """
    recovery_amt:double recovery_amt_uom:string recovery_method:string recovery_obs_no:bigint
    recovery_type:string remark:string row_changed_date:timestamp test_number:string
"""

WELL_TEST_FLOW = """
    fluid_type:string max_fluid_rate:double max_fluid_rate_uom:string row_changed_date:timestamp
    test_number:bigint tts_elasped_time:string
"""

WELL_FORMATION = """
    dominant_lithology:string fault_name:string faulted_ind:boolean form_depth:double form_id:string
    form_obs_no:bigint form_tvd:double gap_thickness:double gx_base_subsea:double gx_dip:string
    gx_dip_azimuth:string gx_eroded_ind:boolean gx_exten_id:string gx_form_base_depth:double
    gx_form_base_tvd:double gx_form_depth_datum:double gx_form_id_alias:string
    gx_form_top_depth:double gx_form_top_tvd:double gx_form_x_coordinate:double
    gx_form_y_coordinate:double gx_gross_thickness:double gx_internal_no:double
    gx_net_thickness:double gx_porosity:double gx_show:string gx_strat_column:string
    gx_top_subsea:double gx_true_strat_thickness:double gx_true_vert_thickness:double
    gx_user1:string gx_user2:string gx_user3:string gx_vendor_no:bigint gx_wellbore_angle:double
    gx_wellbore_azimuth:double percent_thickness:double pick_location:string pick_qualifier:string
    pick_quality:string pick_type:string public:string remark:string row_changed_date:timestamp
    source:string unc_fault_obs_no:bigint unc_fault_source:string unconformity_name:string
    uwi:string
"""

# Initial-potential tests also list their group keys.
IP_WELL_TEST = WELL_TEST + """
    run_number:string source:string test_type:string uwi:string
"""

WELL_PERFORATION = """
    base_depth:double base_form:string cluster:string completion_obs_no:bigint
    completion_source:string current_status:string gx_base_form_alias:string
    gx_top_form_alias:string perforation_angle:double perforation_count:bigint
    perforation_date:timestamp perforation_density:double perforation_diameter:double
    perforation_diameter_ouom:string perforation_obs_no:bigint perforation_per_uom:string
    perforation_phase:string perforation_type:string remark:string row_changed_date:timestamp
    source:string stage:string top_depth:double top_form:string uwi:string
"""

WELL_CUMULATIVE_PRODUCTION = """
    activity_type:string average_gas_volume:double average_injection_volume:double
    average_oil_volume:double average_total_fluids_volume:double average_water_volume:double
    cumulative_gas_volume:double cumulative_injection_volume:double cumulative_oil_volume:double
    cumulative_total_fluids_volume:double cumulative_water_volume:double first_gas_volume:double
    first_gas_volume_date:timestamp first_injection_volume:double first_oil_volume:double
    first_oil_volume_date:timestamp first_total_fluids_date:timestamp
    first_total_fluids_volume:double first_water_volume:double first_water_volume_date:timestamp
    gas_eur:double gas_reserves:double gx_percent_allocation:double last_gas_volume:double
    last_gas_volume_date:timestamp last_injection_volume:double last_oil_volume:double
    last_oil_volume_date:timestamp last_total_fluids_date:timestamp last_total_fluids_volume:double
    last_water_volume:double last_water_volume_date:timestamp max_gas_volume:double
    max_injection_volume:double max_oil_volume:double max_total_fluids_volume:double
    max_water_volume:double min_gas_volume:double min_injection_volume:double min_oil_volume:double
    min_total_fluids_volume:double min_water_volume:double oil_eur:double oil_reserves:double
    row_changed_date:timestamp uwi:string volume_method:double zone_id:string
"""

GX_PDEN_VOL_SUM_BY_MONTH = """
    gas_volume:double gx_percent_allocation:double oil_volume:double pden_date:timestamp
    pden_source:string prod_time:double row_changed_date:timestamp volume_month:bigint
    volume_year:bigint water_volume:double
"""

LOG_IMAGE_REG_LOG_SECTION = """
    log_section_index:bigint base_depth:double base_depth_ouom:string bottom_left_x_pixel:double
    bottom_left_y_pixel:double bottom_right_x_pixel:double bottom_right_y_pixel:double
    create_date:timestamp create_user_id:string curve_bottom_left_x_pixel:double
    curve_bottom_left_y_pixel:double curve_bottom_right_x_pixel:double
    curve_bottom_right_y_pixel:double curve_top_left_x_pixel:double curve_top_left_y_pixel:double
    curve_top_right_x_pixel:double curve_top_right_y_pixel:double header_bottom_left_x_pixel:double
    header_bottom_left_y_pixel:double header_bottom_right_x_pixel:double
    header_bottom_right_y_pixel:double header_rotation:double header_top_left_x_pixel:double
    header_top_left_y_pixel:double header_top_right_x_pixel:double header_top_right_y_pixel:double
    log_depth_cal_vid:string log_section_name:string num_depth_cal_pts:bigint remark:string
    source_registration_filename:string tif_file_identifier:string tif_file_path:string
    tif_filename:string top_depth:double top_depth_ouom:string top_left_x_pixel:double
    top_left_y_pixel:double top_right_x_pixel:double top_right_y_pixel:double update_date:timestamp
    update_user_id:string well_id:string
"""

WELL_DIR_SRVY_STATION = """
    azimuth:double azimuth_ouom:string ew_direction:string gx_closure:string
    gx_station_latitude:double gx_station_longitude:double inclination:double
    inclination_ouom:string ns_direction:string row_changed_date:timestamp source:string
    station_id:string station_md:double station_md_ouom:string station_tvd:double
    station_tvd_ouom:string survey_id:string uwi:string x_offset:double x_offset_ouom:string
    y_offset:double y_offset_ouom:string
"""

WELL_DIR_SRVY = """
    azimuth_north_type:string base_depth:double base_depth_ouom:string calculation_required:string
    compute_method:string ew_magnetic_declination:double grid_system_id:string
    gx_base_e_w_offset:double gx_base_latitude:double gx_base_location_string:string
    gx_base_longitude:double gx_base_n_s_offset:double gx_base_tvd:double gx_closure:double
    gx_footage:string gx_kop_e_w_offset:double gx_kop_latitude:double gx_kop_longitude:double
    gx_kop_md:double gx_kop_n_s_offset:double gx_kop_tvd:double magnetic_declination:double
    north_reference:string offset_north_type:string record_mode:string remark:string
    row_changed_date:timestamp source:string source_document:string survey_company:string
    survey_date:timestamp survey_id:string survey_quality:string survey_type:string top_depth:double
    top_depth_ouom:string uwi:string
"""

WELL_DIR_PROPOSED_SRVY = """
    azimuth_north_type:string base_depth:double base_depth_ouom:string calculation_required:string
    compute_method:string ew_magnetic_declination:double grid_system_id:string gx_active:string
    gx_base_e_w_offset:double gx_base_latitude:double gx_base_location_string:string
    gx_base_longitude:double gx_base_n_s_offset:double gx_base_tvd:double gx_closure:double
    gx_footage:string gx_kop_e_w_offset:double gx_kop_latitude:double gx_kop_longitude:double
    gx_kop_md:double gx_kop_n_s_offset:double gx_kop_tvd:double gx_lp_e_w_offset:double
    gx_lp_n_s_offset:double gx_lp_tvd:double gx_scenario_name:string magnetic_declination:double
    north_reference:string offset_north_type:string record_mode:string remark:string
    row_changed_date:timestamp source:string source_document:string survey_company:string
    survey_date:timestamp survey_id:string survey_quality:string survey_type:string top_depth:double
    top_depth_ouom:string uwi:string
"""

GX_WELL_CURVE = """
    wellid:string curveset:string curvename:string version:bigint cmd_type:string curve_uom:string
    curve_ouom:string date_modified:timestamp description:string tool_type:string remark:string
    topdepth:double basedepth:double
"""

GX_WELL_CURVESET = """
    wellid:string curveset:string topdepth:double basedepth:double depthincr:double log_job:string
    log_trip:string source_file:string remark:string type:string fielddata:string
    import_date:timestamp
"""

GX_WELL_CURVE_VALUES = """
    wellid:string curveset:string curvename:string version:bigint curve_values:binary
"""

WELL = """
    uwi:string abandonment_date:timestamp assigned_field:string base_node_id:string
    bottom_hole_latitude:double bottom_hole_longitude:double casing_flange_elev:double
    casing_flange_elev_ouom:string common_well_name:string completion_date:timestamp
    confidential_date:timestamp confidential_depth:double confidential_depth_ouom:string
    confidential_form:string confidential_type:string country:string county:string
    current_class:string current_status:string current_status_date:timestamp depth_datum:string
    depth_datum_elev:double depth_datum_elev_ouom:string discovery_ind:string district:string
    drill_td:double drill_td_ouom:string faulted_ind:string final_drill_date:timestamp
    final_td:double final_td_ouom:string geodetic_datum_id:string geographic_region:string
    geologic_province:string ggx_internal_status:string ground_elev:double ground_elev_ouom:string
    ground_elev_type:string gx_alternate_id:string gx_bottom_hole_ew_direction:string
    gx_bottom_hole_ns_direction:string gx_bottom_hole_tvd:double gx_bottom_hole_x_offset:double
    gx_bottom_hole_y_offset:double gx_formid:string gx_formid_alias:string gx_legal_string:string
    gx_location_string:string gx_mag_declination:double gx_old_id:string gx_oldest_form_alias:string
    gx_original_units:string gx_percent_allocation:double gx_permit_date:timestamp gx_point:string
    gx_proposed_flag:string gx_remarks:string gx_rigfloor_elev:double gx_td_form_alias:string
    gx_user_date:timestamp gx_user1:string gx_user2:string gx_wsn:bigint initial_class:string
    kb_elev:double kb_elev_ouom:string lease_name:string lease_number:string
    legal_survey_type:string log_td:double log_td_ouom:string max_tvd:double max_tvd_ouom:string
    net_pay:double net_pay_ouom:string oldest_form:string oldest_form_age:string operator:string
    original_operator:string parent_relationship_type:string parent_uwi:string platform_id:string
    platform_source:string plot_name:string plot_symbol:string plugback_depth:double
    plugback_depth_ouom:string primary_source:string profile_type:string province_state:string
    regulatory_agency:string rig_release_date:timestamp row_changed_date:timestamp
    source_document:string spud_date:timestamp surface_latitude:double surface_longitude:double
    surface_node_id:string tax_credit_code:string td_form:string td_form_age:string
    water_depth:double water_depth_datum:string water_depth_ouom:string well_govt_id:string
    well_intersect_md:double well_name:string well_number:string whipstock_depth:double
    whipstock_depth_ouom:string
"""

LEGAL_CONGRESS_LOC = """
    bh_flag:string congress_range:string congress_sect_suffix:string congress_sect_type:string
    congress_section:string congress_township:string congress_twp_name:string country:string
    county:string ew_direction:string ew_footage:string ew_footage_ouom:string ew_start_line:string
    footage_origin:string location_type:string ns_direction:string ns_footage:string
    ns_footage_ouom:string ns_start_line:string polygonid:string principal_meridian:string
    province_state:string remark:string row_changed_date:string source:string spot_code:string
"""

WELL_ZONE_INTERVAL = """
    base_md:double base_tvd:double base_x:double base_y:double md:double mdss:double remark:string
    row_changed_date:timestamp top_md:double top_tvd:double top_x:double top_y:double tvd:double
    tvdss:double uwi:string x:double y:double zone_name:string
"""

WELL_ZONE_INTRVL_VALUE = """
    gx_remark:string row_changed_date:timestamp uwi:string zattribute_name:string
    zattribute_value_date:timestamp zattribute_value_numeric:double zattribute_value_string:string
    zone_name:string
"""

GX_ZONE_ZATTRIBUTE = """
    gx_remark:string row_changed_date:timestamp zattribute_name:string zone_name:string
"""

GX_ZATTRIBUTE = """
    domain:string gx_remark:string row_changed_date:timestamp zattribute_decimals:bigint
    zattribute_name:string zattribute_type:bigint zattribute_value_unit:string
"""

GX_ZONE = """
    domain:string gx_base_form_name:string gx_base_form_tb:string gx_base_modifier:string
    gx_base_offset:double gx_remark:string gx_top_form_name:string gx_top_form_tb:string
    gx_top_modifier:string gx_top_offset:double gx_topmidbase:string row_changed_date:timestamp
    zone_name:string
"""


TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "bigint": T.LongType(),
    "timestamp": T.TimestampNTZType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
}


def kinds(columns: str) -> dict[str, str]:
    """Name to type of a table's columns: of a list's elements, or of a scalar that a table lacks."""
    return dict(column.split(":") for column in columns.split())
