"""The named results: reporting views, panels, alerts, forecasts, segments."""
