"""Hand-written raw tables for unit tests (same raw schema as the adapter produces)."""

from marketlens.model import Marketplace

USERS = ("user_id long, user_name string, signup_date string, acquisition_channel string, city string, "
         "device_type string, age long, gender string, profession string, income_bracket string, "
         "is_subscriber int, ab_test_group string")
RESTAURANTS = ("restaurant_id long, restaurant_name string, cuisine_type string, city string, onboarded_date string, "
               "commission_rate double, base_rating double")
RIDERS = "delivery_partner_id long, partner_name string, city string, joined_date string, vehicle_type string"
ORDERS = ("order_id long, user_id long, restaurant_id long, delivery_partner_id long, order_placed_time string, "
          "order_accepted_time string, promised_delivery_time string, ready_time string, pickup_time string, "
          "delivered_time string, order_status string, cancel_reason string, items_count long, order_value double, "
          "discount_amount double, delivery_fee double, delivery_cost_to_rider double, payment_gateway_fee double, "
          "commission_rate double, payment_method string, payment_status string, distance_km double, "
          "refund_amount double, rating long, complaint_flag int, wrong_item_flag int, is_promo_used int, "
          "is_scheduled_order int, ab_test_group string, device_type string, city string")
EVENTS = "event_id long, session_id string, user_id long, event_name string, event_time timestamp_ntz, device_type string"
NPS = "response_id long, user_id long, response_date string, nps_score long"

USER_DEFAULTS = dict(user_name="u", signup_date="2024-01-01", acquisition_channel="Organic", city="Pune",
                     device_type="iOS", age=30, gender="Female", profession="Student", income_bracket="Mid (3-8L)",
                     is_subscriber=0, ab_test_group="Control")
ORDER_DEFAULTS = dict(restaurant_id=1, delivery_partner_id=1, order_placed_time="2024-01-10 12:00:00",
                      order_accepted_time="2024-01-10 12:02:00", promised_delivery_time="2024-01-10 12:45:00",
                      ready_time="2024-01-10 12:20:00", pickup_time="2024-01-10 12:22:00",
                      delivered_time="2024-01-10 12:40:00", order_status="Delivered", cancel_reason=None,
                      items_count=2, order_value=100.0, discount_amount=0.0, delivery_fee=20.0,
                      delivery_cost_to_rider=30.0, payment_gateway_fee=2.0, commission_rate=0.2,
                      payment_method="UPI", payment_status="Success", distance_km=3.0, refund_amount=0.0, rating=5,
                      complaint_flag=0, wrong_item_flag=0, is_promo_used=0, is_scheduled_order=0,
                      ab_test_group="Control", device_type="iOS", city="Pune")


def _rows(schema: str, defaults: dict, rows: list[dict]) -> list[tuple]:
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    return [tuple(r.get(n, defaults.get(n)) for n in names) for r in rows]


def raw_marketplace(spark, users=(), orders=(), events=(), nps=(), restaurants=None) -> Marketplace:
    restaurants = restaurants if restaurants is not None else [
        (1, "r1", "Italian", "Pune", "2023-01-01", 0.2, 4.0), (2, "r2", "Bakery", "Pune", "2023-01-01", 0.2, 4.0),
        (3, "r3", "Chinese", "Pune", "2023-01-01", 0.2, 4.0)]
    return Marketplace(
        users=spark.createDataFrame(_rows(USERS, USER_DEFAULTS, list(users)), USERS),
        restaurants=spark.createDataFrame(restaurants, RESTAURANTS),
        riders=spark.createDataFrame([(1, "p", "Pune", "2023-01-01", "Bike")], RIDERS),
        orders=spark.createDataFrame(_rows(ORDERS, ORDER_DEFAULTS, list(orders)), ORDERS),
        events=spark.createDataFrame(list(events), EVENTS),
        nps=spark.createDataFrame(list(nps), NPS),
    )
