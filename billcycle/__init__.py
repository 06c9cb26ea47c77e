"""DataFrame operators for subscription billing cycles, snapshot comparison and monthly KPIs."""
